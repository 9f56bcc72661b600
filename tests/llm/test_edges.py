"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, contamination, html, language, mixing, neardup, quality, sharding, tokens, urls

try:
    import public_tokenizers
except ImportError:  # only the token tests need it
    public_tokenizers = None
TOKENIZER = public_tokenizers.path(tokens.DEFAULT_FILE) if public_tokenizers else ""
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t", "en", "a"), (4, "one two", "en", "b"), (4, "one two", "en", "b"), (None, "one two three four five six", "de", "b"), (7, LONG, "en", "a"), (8, LONG, "en", None), (9, "\x00 é ß İ", "fr", "")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_quality(docs):
    rows = quality.cross_document_lines(docs.withColumn("_extra", F.lit(1))).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].kept, by[7].n_words, by[7].n_repeat_words, by[7].base_failed) == (0, False, 60_000, 60_000, True)
    assert quality.cross_document_lines(docs.limit(0)).count() == 0
    assert quality.clean_documents(docs).columns == docs.columns
    inner = {c: F.lit(7) for c in ("_hits", "_removed", "_words", "words", "_k1", "_host", "_line", "row")}
    more = docs.sparkSession.createDataFrame([(50, " ".join(f"w{k}" for k in range(60)), "en", "a")], SCHEMA).union(docs)
    for make in (quality.cross_document_lines, quality.clean_documents, quality.text_statistics):
        assert make(more.withColumns(inner)).select(*inner).distinct().collect() == [(7,) * len(inner)]
    for name in ("n_words", "Kept", "base_failed"):
        with pytest.raises(ValueError, match=name.lower()):
            quality.cross_document_lines(docs.withColumn(name, F.lit(1)))
        assert quality.clean_documents(docs.withColumn(name, F.lit(7))).columns == [*docs.columns, name]


def test_quality_removes_shared_lines_and_spares_copies(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, f"{body(k)}\nAll  RIGHTS reserved.", "h", 0) for k in range(40)] + [(100 + k, f"{body(99)}\nsecond line {body(98)}", "h", 0) for k in range(30)]
    rows += [(200, " ".join(f"u{i}" for i in range(60)) + "\n" + "\n".join(["all rights reserved."] * 40), "h", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.cross_document_lines(df).collect()}
    assert got[0].n_removed_words == 3 and got[0].kept
    assert got[100].n_removed_words == 0 and got[100].kept
    assert not got[200].kept
    clean = {r.doc_id: r for r in quality.clean_documents(df).collect()}
    assert clean[0].text == body(0) and clean[0].n_chars == len(body(0)) and 200 not in clean


def test_quality_removes_boilerplate_of_many_lines(spark):
    """Lines that sort low or protect one another, on some documents of a host and on all; near copies stay."""
    body = lambda k: "\n".join(" ".join(f"w{k}x{j}x{i}" for i in range(20)) for j in range(6))
    low = ["1 about us", "accept cookies", "all rights reserved"]
    rows = [(k, "\n".join([*low, body(k)]), "h") for k in range(40)]
    edited = lambda k: "\n".join(x + (f" e{k}" if j == k % 6 else "") for j, x in enumerate(body(500).split("\n")))
    rows += [(100 + k, edited(k), "h") for k in range(30)]
    rows += [(200 + k, "\n".join([f"{n} menu entry of this host" for n in range(20)] + [" ".join(f"v{k}x{i}" for i in range(50))]), "all") for k in range(30)]
    rows += [(300 + k, "\n".join(["0 shared line", *body(300 + k % 12).split("\n")]), "copies") for k in range(2400)]
    got = {r.doc_id: r for r in quality.cross_document_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[k].n_removed_words for k in range(40)} == {8} and all(got[k].kept for k in range(40))
    assert {got[100 + k].n_removed_words for k in range(30)} == {0} and all(got[100 + k].kept for k in range(30))
    assert {got[200 + k].n_removed_words for k in range(30)} == {120} and not any(got[200 + k].kept for k in range(30))
    assert {got[300 + k].n_removed_words for k in range(2400)} == {3}


def test_repeated_words_by_brute_force(spark):
    texts = ["a a a a", "a b c d a b c", "x y z", "x y", "a b a b a b q r s t q r s", "p q r p q r p q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in quality.text_statistics(df).collect():
        w = r.text.split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r.n_repeat_words == len({i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(3)}), r.text


def test_near_duplicates(docs, spark):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert len(got) == len(ROWS)
    assert (8, 977, 7, False) in got and got.count((4, 1, 4, True)) == 2 and (1, 0, 1, True) in got and (-1, 2, None, True) in got
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicate_families_by_brute_force(spark):
    """A large family around one text, chains of it, and the round trip through every kind of group."""
    import random

    rnd = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            w[rnd.randrange(60)] = f"e{rnd.randrange(40)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:k]) for k in range(40, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_contamination(docs, spark):
    item = spark.createDataFrame([(1, "Word5 word6 WORD7 word8 word9 word10 word11"), (2, None), (3, ""), (4, "one two"), (4, "one two")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_found) for r in contamination.contaminated_pairs(docs, item).collect())
    assert got == [(4, 4, 1)] * 4 + [(7, 1, 3), (8, 1, 3)]
    blocks = contamination.contaminated_pairs(docs, item, block_words=2)
    assert sorted((r.doc_id, r.item_id, r.n_found) for r in blocks.collect()) == got
    assert contamination.decontaminated(docs, item).count() == len(ROWS) - 4
    assert contamination.contaminated_pairs(docs.limit(0), item).count() == contamination.contaminated_pairs(docs, item.limit(0)).count() == 0


def test_mixing(docs):
    rows = mixing.mix(docs.withColumn("rank", F.lit(0))).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 2 for r in rows)
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    again = mixing.mix(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.copies) for r in rows))) == sorted(map(str, ((r.doc_id, r.source, r.copies) for r in again)))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in rows)
    with pytest.raises(ValueError, match="target"):
        mixing.mix(docs.withColumn("target", F.lit(1)))
    clash = {c: F.lit(7) for c in ("size", "target", "copies", "_n", "_part", "_tie", "_copy", "part", "start", "row", "rank")}
    mixed = mixing.mixed_rows(docs.withColumns(clash))
    assert mixed.columns == [*docs.columns, *clash] and mixed.select(*clash).distinct().collect() == [(7,) * len(clash)]
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


def test_sharding(docs):
    keys = sharding.document_keys(docs)
    rows = sharding.shard(keys, 4, ["doc_id", "text_crc32", "size"]).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(4))
    assert {r.doc_id: r.text_crc32 for r in rows}[9] == zlib.crc32("\x00 é ß İ".encode())
    f = sharding.Feistel(len(rows))
    assert all((r.shard, r.slot) == (f(r.row_number) % 4, f(r.row_number) // 4) for r in rows)
    assert sharding.shard(keys.limit(0), 4, ["doc_id"]).count() == 0
    clash = {c: F.lit(7) for c in ("_p", "part", "at", "start", "row", "tie", "key0")}
    assert sharding.shard(keys.withColumns(clash), 4, ["doc_id"]).select(*clash).distinct().collect() == [(7,) * len(clash)]
    with pytest.raises(ValueError, match="slot"):
        sharding.shard(keys.withColumn("Slot", F.lit(1)), 4, ["doc_id"])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 1000, 4099])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, "s")
    assert sorted(map(f, range(n))) == list(range(n))
    for x in range(min(n, 200)):
        y, steps = f._once(x), 0
        while y >= n:
            y, steps = f._once(y), steps + 1
        assert steps <= f.walks


def test_urls(spark):
    given = [None, "", "no scheme", "http://NET", "http://a.net/x", "http://example.net/en/1?q#f", "https://m.Example.com/de/", "http://x.org/fr", "http://x.org/fr/", "http://spam-farm.example.org/en/1", "http://a.spam-farm.example.com#/de/", "http://notexample.net?/en/", "ftp://fr.org//fr/"]
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(given)] + [(4, given[4], "mine")], "page_id long, url string, key string")
    rows = urls.judge_urls(df).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(given) + 1
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "", None, "allow") and got[4] == ("a.net", "/x", "net/", "block")
    assert got[5] == ("example.net", "/en/1", "example.net/en/", "allow") and got[6][2:] == ("example.com/de/", "block")
    assert got[7][2:] == (None, "allow") and got[8][2:] == ("org/fr/", "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "block") and got[11][2] is None and got[12][2] is None
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert urls.judge_urls(df, [], []).filter("verdict = 'block'").count() == 0
    clash = {c: F.lit(7) for c in ("keys", "_keys", "found", "_found", "row")}
    assert urls.judge_urls(df.withColumns(clash)).select(*clash).distinct().collect() == [(7,) * len(clash)]
    with pytest.raises(ValueError, match="verdict"):
        urls.judge_urls(df.withColumn("Verdict", F.lit(1)))


def test_cascade_is_exact(spark):
    listed = spark.range(0, 300).selectExpr("concat('k', id) AS key")
    universe = spark.range(0, 20_000).selectExpr("concat('k', id) AS key")
    for bits, parts in ((urls.MAX_BITS, 1), (1000, 4)):
        cascade = urls.build_cascade(listed, universe, bits)
        assert len(cascade.parts) >= parts
        assert universe.filter(cascade.has(F.col("key"))).count() == 300 == listed.filter(cascade.has(F.col("key"))).count()


def test_html(spark):
    page = '<html><head><title>t</title></head><body><header>Top</header><div class="cookie-notice">We use</div><article><h1>T &amp; x&nbsp;y</h1><p>a <span class="ad">buy</span> b<br>c<p>second <b>bold</b><script>"</p>"</script> tail<ul><li>one<li>two</ul><div class="comments"><p>hi</p></div><form>f</form></article><aside>s</aside></body>'
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "http://a.b/c", page), (3, "http://a.b/c", page), (4, "x", "<p>unclosed &lt; &#233"), (5, None, "<p>" + "long " * 50_000)], "page_id long, url string, html string")
    for limit in (html.BROADCAST_ROWS, 0):
        rows = html.main_texts(pages.withColumn("more", F.lit(1)), broadcast_rows=limit).collect()
        got = {r.page_id: r.text for r in rows}
        assert len(rows) == 6 and got[1] == got[2] == "" and got[4] == "unclosed < é" and got[5] == ("long " * 50_000).strip()
        assert got[3] == "T & x y\na b c\nsecond bold tail\none\ntwo"
    assert html.main_texts(pages.limit(0)).count() == 0


def test_templates_go_and_copied_articles_stay(spark):
    unique = lambda k: f"<div><p>text {k} of its own</p></div>"
    rows = [(k, "http://h.x/", f"<body><div>Same box <ul><li>a</ul></div>{unique(k)}</body>") for k in range(20)]
    rows += [(100 + k, "http://h.x/", "<body><div><p>copied article</p></div><div><p>its second part</p></div></body>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html.BROADCAST_ROWS, 0):
        got = {r.page_id: r.text for r in html.main_texts(pages, broadcast_rows=limit).collect()}
        assert got[3] == "text 3 of its own" and got[100] == "copied article\nits second part"


def test_templates_of_many_blocks_go(spark):
    """Template blocks that outnumber a page's own; near copies, and a host of mostly equal pages, as well."""
    menu = lambda h: "".join(f"<div>menu entry {n} of {h}</div>" for n in range(20))
    own = lambda k: "".join(f"<div>own text {j} of page {k}</div>" for j in range(5))
    text = lambda k: "\n".join(f"own text {j} of page {k}" for j in range(5))
    edited = lambda k: "".join(f"<div>copied part {j}{f' edit {k}' if j == k % 5 else ''}</div>" for j in range(5))
    rows = [(h * 100 + k, f"http://h{h}.x/", f"<body>{menu(h)}{own(k)}</body>") for h in range(6) for k in range(30)]
    rows += [(1000 + k, "http://h0.x/", f"<body>{menu(0)}{edited(k)}</body>") for k in range(15)]
    rows += [(2000 + k, "http://e.x/", f"<body>{menu('e')}{own(k % 12)}</body>") for k in range(300)]
    rows += [(3000 + k, "http://e.x/", "<body><div>one page</div></body>") for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html.BROADCAST_ROWS, 0):
        got = {r.page_id: r.text for r in html.main_texts(pages, broadcast_rows=limit).collect()}
        assert all(got[h * 100 + k] == text(k) for h in range(6) for k in range(30))
        assert all(got[1000 + k].count("copied part") == 5 and "menu" not in got[1000 + k] for k in range(15))
        assert all(got[2000 + k] == text(k % 12) for k in range(300)) and got[3000] == "one page"


def test_tokens(docs):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    rows = tokens.token_counts(docs, TOKENIZER).collect()
    want = sorted((len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in ROWS)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want and all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert tokens.token_counts(docs.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        tokens.token_counts(docs.withColumn("n_tokens", F.lit(1)), TOKENIZER)
    text = "It's a <|endoftext|>Straße, naïve e\u0301clair\tİx 123!! we'll  see<|endof\n汉字们"
    one = docs.sparkSession.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    counted = tokens.prefix_counts(one.withColumn("piece", F.lit(7)), TOKENIZER)
    r, none = counted.withColumn("n", tokens.tokens_before(F.lit(12))).withColumn("c", tokens.chars_within(F.lit(6))).orderBy("doc_id").collect()
    want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert r.prefix_tokens == want and (r.n, r.piece) == (want[12], 7)
    assert r.c == max(k for k, n in enumerate(want) if n <= 6)
    for limit in (0, 1, 5, 17, len(want)):
        fit = {r.doc_id: r.fit_chars for r in tokens.token_counts(one, TOKENIZER, limit).collect()}
        assert fit == {1: max(k for k, n in enumerate(want) if n <= limit), 2: 0}
    assert none.prefix_tokens == [0] and (none.n, none.c) == (0, 0)


def test_truncation_by_the_library(spark, sf_dir):
    """Every prefix of the given texts, and the longest that fits a budget."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(60)
    held = {r.doc_id: r.text for r in texts.collect()}
    rows = {r.doc_id: r for r in tokens.token_counts(texts, TOKENIZER, limit=40).collect()}
    stored = tokens.written(tokens.prefix_tables(texts, TOKENIZER, limit=40), "stored")
    from_runs = {r.doc_id: r.prefix_tokens for r in tokens.stored_prefixes(stored).collect()}
    for r in tokens.prefix_counts(texts, TOKENIZER).collect():
        assert from_runs[r.doc_id] == r.prefix_tokens
        text = held[r.doc_id]
        assert r.prefix_tokens == [len(e.ids) for e in lib.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert rows[r.doc_id].n_tokens == r.prefix_tokens[-1]
        assert rows[r.doc_id].fit_chars == max(k for k, n in enumerate(r.prefix_tokens) if n <= 40)


def test_stored_prefixes_in_blocks_of_any_size(docs, monkeypatch):
    pytest.importorskip("public_tokenizers")
    want = sorted((r.doc_id or -1, r.prefix_tokens) for r in tokens.prefix_counts(docs, TOKENIZER).collect())
    for size in (1, 40, tokens.BLOCK_BYTES):
        monkeypatch.setattr(tokens, "BLOCK_BYTES", size)
        stored = tokens.written(tokens.prefix_tables(docs.coalesce(2), TOKENIZER), "stored")
        assert stored.filter("first is null").select("doc_id", "lang", "source").count() == len(ROWS)
        assert sorted((r.doc_id or -1, r.prefix_tokens) for r in tokens.stored_prefixes(stored).collect()) == want


def test_token_counts_of_random_strings(spark):
    """Whole ranges of code points, unassigned ones among them, counted as the library counts them."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rnd = __import__("random").Random(4)
    ranges = [(32, 127), (0x80, 0x250), (0x370, 0x600), (0x900, 0xE00), (0x1E00, 0x2100), (0x3040, 0xA000), (0xAC00, 0xD7A4), (0xFB00, 0xFE00), (0x10000, 0x1F000)]
    make = lambda: "".join(rnd.choice(" \n'") if rnd.random() < 0.15 else chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 14)))
    texts = [make() for _ in range(20_000)]
    lib = Tokenizer.from_file(TOKENIZER)
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = {r.k: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), TOKENIZER).collect()}
    assert [k for k, n in enumerate(want) if got[k] != n] == []


def test_token_prefixes_inside_pieces():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, c = Tokenizer.from_file(TOKENIZER), tokens.counter(TOKENIZER)
    for piece in ("internationalisation", "xyzzyqwertyuiop", "the", "zzzzzzzzzz"):
        _, whole = c.prefixes(piece)
        assert whole == [len(lib.encode(piece[:k], add_special_tokens=False).ids) for k in range(len(piece) + 1)]


def test_new_pieces_are_counted_together(monkeypatch):
    """A block's short pieces cost no step each; all prefixes of runs count as the library counts them, in parts of any size."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, rnd = Tokenizer.from_file(TOKENIZER), random.Random(4)
    runs = ["", "a", "isn't", "x" * tokens.TOGETHER_BYTES, "\u00e9t\u00e9,", "na\u00efve-2024", "e\u0301t", "\u65e5\u672c\u8a9e"]
    runs += list({"".join(rnd.choice("aeinrst" if k % 2 else "abcXYZ019.,\u00fc\u00df") for _ in range(rnd.randint(1, 18))) for k in range(400)})
    want = [[len(e.ids) for e in lib.encode_batch([r[:k] for k in range(len(r) + 1)], add_special_tokens=False)] for r in runs]
    for size in (3, tokens.TOGETHER):
        monkeypatch.setattr(tokens, "TOGETHER", size)
        assert [list(t) for t in tokens.PieceCounter(TOKENIZER).tables(runs)] == want
    c, long = tokens.PieceCounter(TOKENIZER), "thein" * 30
    assert list(c.tables([long])[0]) == [0, *c.prefixes(long)[1][1:]]
    monkeypatch.setattr(tokens.PieceCounter, "_step", None)
    assert [list(t) for t in tokens.PieceCounter(TOKENIZER).tables(["inter", "\u00e9t\u00e9,", "2024"])] == [[len(lib.encode(r[:k], add_special_tokens=False).ids) for k in range(len(r) + 1)] for r in ("inter", "\u00e9t\u00e9,", "2024")]


def test_words_with_signs_are_not_split_apart(monkeypatch):
    """Runs of letters, with signs behind them, are put together from pieces counted once; what looks like them goes the way of all others."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, rnd = Tokenizer.from_file(TOKENIZER), random.Random(7)
    count = lambda texts: [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    runs = ["a'", "a's", "a'S!", "don't", "\u00aa\u00ba", "\u00d7a\u00f7", "\u0130x", "</w>", "a</w>", "\u00e9" * 16, "\u00e9" * 17, "a" + "!" * 33, "x" * 40 + "?"]
    runs += ["".join(rnd.choice("aZ\u00e9\u00c9\u00df\u00ff\u00c0\u00d7\u00b51'.,!<>\u017f") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    assert [list(t) for t in tokens.PieceCounter(TOKENIZER).tables(runs)] == [count([r[:k] for k in range(len(r) + 1)]) for r in runs]
    block, texts = tokens.Block(0), ["", "Z\u00fcrich,\nici  l\u00e0", "a <|endoftext|> b", "ici"]
    for t in texts:
        block.add(tokens.counter(TOKENIZER), t)
    found, units, starts = block.runs()
    assert [[found[u] for u in units[a:b]] for a, b in zip(starts, starts[1:])] == [[""], ["Z\u00fcrich,", "ici", "", "l\u00e0"], ["\na <|endoftext|> b"], ["ici"]]
    monkeypatch.setattr(tokens.PieceCounter, "_pieces", None)
    words = ["inter", "Stra\u00dfe...", "\u00c9T\u00c9,", "x*()"]
    assert [list(t) for t in tokens.PieceCounter(TOKENIZER).tables(words)] == [count([r[:k] for k in range(len(r) + 1)]) for r in words]


def test_language(docs, spark):
    rnd = __import__("random").Random(2)
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [(k, make("abcde" if k % 2 else "vwxyz"), "aa" if k % 2 else "zz") for k in range(120)] + [(500, None, "aa"), (501, "123 !!", "aa"), (502, make("abcde"), None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == ("aa" if k % 2 else "zz") for k in range(120))
    assert (got[500].lang_pred, got[501].lang_pred, got[502].lang_pred, got[500].score) == ("und", "und", "aa", 0)
    assert got[3].held_out == (zlib.crc32(b"3") % 4 == 2)
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, score int").withColumns({c: F.lit(7) for c in ("_rank", "held_out", "lang_pred")})
    assert {r.lang_pred for r in language.identify(df).collect()} == {"aa", "zz", "und"}
    assert language.training_rows(df, 300, 10).groupBy("lang").count().agg(F.max("count")).first()[0] == 5
    assert language.training_rows(df, 300, 0).count() == 2


def test_clashes_of_the_rest(docs, spark):
    clash = {c: F.lit(7) for c in ("item_id", "n_found", "containment", "key", "set")}
    item = spark.createDataFrame([(1, "Word5 word6 WORD7 word8 word9")], "item_id long, text string")
    assert contamination.contaminated_pairs(docs.withColumns(clash), item.withColumn("doc_id", F.lit(3))).count() == 2
    assert contamination.decontaminated(docs.withColumns(clash), item).columns == [*docs.columns, *clash]
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.rendered_turns(turns.withColumn("n_turns", F.lit(7)))).first().n_turns == 2


def test_stages_take_any_columns_and_empty_tables(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    clash = {c: F.lit(7) for c in ("size", "copies", "_words", "kept", "row", "shard_", "component_id", "class", "_n", "n_words")}
    for docs in (documents.withColumns(clash), documents.withColumns(clash).limit(0), documents.union(documents).withColumns(clash)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "sharding" or out.columns == docs.columns, name
            assert out.count() >= 0


def test_chat(spark):
    import hashlib

    hard = ["", None, "<|im_end|>", "<\\|im_end|>\n<|im_start|>user\nx<|im_end|>\n", "a\n" * 1000, "ends with <"]
    rows = [(c, k, role, t) for c, role in ((1, "assistant"), (2, "user"), (None, "we\n<|im_end|>ird\\n")) for k, t in enumerate(hard)] + [(1, 0, "assistant", "again"), (1, 0, "assistant", "again")]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.rendered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in (1, 2, None):
        own = sorted(((k, role, t or "") for c, k, role, t in rows if c == conv), key=lambda x: x)
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.rendered_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_contamination_sends_one_block_at_a_time(spark):
    """Many blocks of items: no plan holds more than the pass that ran last, and the rows are those of one block."""
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(40)]
    docs = spark.createDataFrame([(k, f"start {texts[k]} end") for k in range(0, 40, 2)] + [(100, "nothing of it at all in here")], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    many, one = (contamination.decontaminated(docs, items, block_words=w) for w in (150, 10**6))
    assert many.collect() == one.collect() and [r.doc_id for r in many.collect()] == [100]
    assert "MapInArrow" not in many._jdf.queryExecution().executedPlan().toString()
    pairs = contamination.contaminated_pairs(docs, items, block_words=150)
    assert sorted((r.doc_id, r.item_id) for r in pairs.collect()) == [(k, k) for k in range(0, 40, 2)]
    assert "MapInArrow" not in pairs._jdf.queryExecution().executedPlan().toString()
