"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, clustering, contamination, fingerprints, html, language, mixing, neardup, quality, sharding, tokens, urls
from .common import words, written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    narrow = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    return mixing.mix(narrow, sizes="size").select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = written(sharding.document_keys(_read(spark, sf_dir, "documents")), "doc-keys")
    out = sharding.shard(keys, 24, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path(tokens.DEFAULT_FILE))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated_pairs(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(fixed, "conv_id long, turn long, role string, text string"))
    return chat.conversation_digests(chat.rendered_turns(rows))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.cross_document_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.aligned_documents(docs, public_tokenizers.path(alignment.FILE_A), public_tokenizers.path(alignment.FILE_B))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(_read(spark, sf_dir, "embeddings"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _shingles_sql(table: str, key: str) -> str:
    """(key, s): distinct five-word shingles of a table's texts."""
    w = _words_sql(f"translate(text, '{_UP}', '{_LOW}')")
    return f"""SELECT DISTINCT {key}, CASE WHEN len(w) <= 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {key}, {w} AS w FROM {table}) WHERE len(w) > 0)"""


def _mixing_sql() -> str:
    m = mixing
    return f"""WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS sk, CAST(len({_words_sql('text')}) AS BIGINT) AS size FROM documents),
src AS (SELECT sk, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY sk), ranked AS (SELECT *, {list(m.WEIGHTS)}[CAST((row_number() OVER (ORDER BY sk) - 1) % {len(m.WEIGHTS)} + 1 AS INTEGER)] AS w FROM src),
steps AS (SELECT *, {m.MAX_EPOCHS} * ss / w::DOUBLE AS ratio, ({m.BUDGET} * sum(ss) OVER () - coalesce(sum({m.MAX_EPOCHS} * ss) OVER (ORDER BY {m.MAX_EPOCHS} * ss / w::DOUBLE, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (ORDER BY {m.MAX_EPOCHS} * ss / w::DOUBLE, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lam FROM ranked),
share AS (SELECT arg_min(lam, (ratio, sk)) AS lam FROM steps WHERE ratio >= lam), targets AS (SELECT sk, ss, CASE WHEN {m.MAX_EPOCHS} * ss < w * share.lam THEN CAST({m.MAX_EPOCHS} * ss AS DOUBLE) ELSE w * share.lam END AS target FROM ranked, share),
n AS (SELECT d.*, t.ss, t.target, row_number() OVER (PARTITION BY d.sk ORDER BY size, doc_id) - 1 AS n, coalesce(target / nullif(ss, 0)::DOUBLE, 0) AS rate, CAST('0x' || substr(md5(d.sk || ':0'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM d JOIN targets t USING (sk)),
c AS (SELECT *, CAST(floor(u + (n + 1) * rate) - floor(u + n * rate) AS BIGINT) AS copies FROM n)
SELECT doc_id, size, ss AS source_size, target, copies * size AS taken, source, copies FROM c"""


def _near_duplicates_sql() -> str:
    return f"""WITH RECURSIVE sets AS ({_shingles_sql('documents', 'doc_id')}), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= {neardup.SIMILAR_PERCENT} * (x.n + y.n - c)), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)"""


def _contamination_sql() -> str:
    return f"""WITH docs AS ({_shingles_sql('documents', 'doc_id')}), items AS ({_shingles_sql('benchmark', 'item_id')}), sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
found AS (SELECT d.doc_id, i.item_id, count(*) AS c FROM docs d JOIN items i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, c AS n_found, c / n::DOUBLE AS containment FROM found JOIN sizes USING (item_id) WHERE c >= {contamination.CONTAINMENT}::DOUBLE * n"""


def _urls_sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in rules) + " END"
    blocked = " OR ".join(fits(h, "") for h in urls.BLOCKED_HOSTS)
    return f"""WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN split_part(split_part(substr(url, position('://' IN url) + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(split_part(coalesce(rest, ''), '/', 1), '{_UP}', '{_LOW}') AS host, substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path FROM r),
q AS (SELECT *, {rule} AS rule FROM p) SELECT page_id, host, path, rule, coalesce({verdict}, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM q"""


def _chat_sql() -> str:
    shown = r"regexp_replace({}, '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g')"
    role = r"CASE WHEN contains(role, chr(10)) OR contains(role, '\') OR contains(role, '|im_') THEN " + shown.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')") + " ELSE role END"
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(length('{chat.START}') + length({role}) + 1 + length({shown.format('text')}) + length('{chat.END}') + 1) AS BIGINT) AS formatted_chars FROM rows GROUP BY conv_id"""


def _quality_sql() -> str:
    q = quality
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, {_words_sql('text')} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)), twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) s(k) GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
lines AS (SELECT doc_id, host, text, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '')) AS line FROM d),
texts AS (SELECT host, count(DISTINCT text) AS texts FROM d WHERE text IS NOT NULL GROUP BY host), recur AS (SELECT host, line, docs, texts FROM (SELECT host, line, count(DISTINCT text) AS docs FROM lines GROUP BY ALL) JOIN texts USING (host) WHERE docs >= {q.MIN_DOCS} AND docs >= {q.MAX_SHARE}::DOUBLE * texts),
own AS (SELECT l.host, l.text, min(CASE WHEN r.line IS NULL THEN l.line END) AS own, sum(CASE WHEN r.line IS NULL THEN len(string_split(l.line, ' ')) ELSE 0 END) AS own_words, sum(len(string_split(l.line, ' '))) AS all_words FROM lines l LEFT JOIN recur r ON r.host = l.host AND r.line = l.line GROUP BY ALL),
shared AS (SELECT DISTINCT host, line, docs, texts, text FROM lines JOIN recur USING (host, line)), least AS (SELECT host, text, list_sort(list(line)) AS s FROM shared GROUP BY ALL),
placed AS (SELECT host, line, docs, text, coalesce(CASE WHEN (CASE WHEN 2 * docs > texts THEN {q.COPY_PARTS} ELSE 2 END) * own_words < all_words THEN CASE WHEN line = s[1] THEN s[2] ELSE s[1] END END, own) AS family FROM shared JOIN least USING (host, text) JOIN own USING (host, text)),
often AS (SELECT host, line FROM (SELECT host, line, docs, family, count(*) AS n FROM placed GROUP BY ALL) GROUP BY host, line, docs HAVING 2 * max(n) <= docs), gone AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM lines JOIN often USING (host, line) GROUP BY doc_id),
fin AS (SELECT base.*, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words FROM base LEFT JOIN gone USING (doc_id))
SELECT *, NOT base_failed AND n_removed_words <= {q.MAX_REMOVED}::DOUBLE * n_words AS kept FROM fin"""


def _clustering_sql() -> str:
    c, d = clustering, range(1, clustering.DIMENSIONS + 1)
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, {' + '.join(f'(v[{i}] - m[{i}]) * (v[{i}] - m[{i}])' for i in d)} AS d FROM kept, c{k}) GROUP BY vec_id, v)"""
    mean = lambda i: f"(sum(v[{i}])::BIGINT - ((sum(v[{i}])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)"
    move = lambda k: f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN (SELECT c, [{', '.join(map(mean, d))}] AS m FROM a{k} GROUP BY c) n USING (c))"
    steps = ", ".join(f"{near(k)}, {move(k)}" for k in range(c.ROUNDS))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({c.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {c.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{c.SEED}:' || vec_id)) - 1 AS c, v AS m FROM kept ORDER BY sha256('{c.SEED}:' || vec_id) LIMIT {c.CLUSTERS}), {steps}, {near(c.ROUNDS)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{c.ROUNDS} JOIN c{c.ROUNDS} USING (c)"""


def _fingerprints_sql() -> str:
    f = fingerprints
    below = format(int(f.FRACTION * 16**f.HASH_DIGITS), f"0{f.HASH_DIGITS}x")

    def kept(text: str) -> str:
        w = _words_sql(f"lower({text})")
        hashes = f"list_filter([md5(array_to_string(w[i:i + {f.SHINGLE_WORDS - 1}], ' ')) FOR i IN range(1, greatest(len(w) - {f.SHINGLE_WORDS - 2}, 2))], lambda h: h < '{below}')"
        return f"(SELECT CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform({hashes}, lambda h: h[1:{f.HASH_DIGITS}]))) END FROM (SELECT {w} AS w))"

    name = lambda text, hashes: f"CASE WHEN len({hashes}) > 0 THEN array_to_string({hashes}, ',') ELSE '=' || md5(array_to_string({_words_sql(f'lower({text})')}, ' '))[1:{f.HASH_DIGITS}] END"
    alike = lambda p, x: f"CASE WHEN fingerprint = {p} THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(h, {x})) / nullif(len(h) + len({x}) - len(list_intersect(h, {x})), 0)::DOUBLE, 0) END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 4) || left(next_text, n_chars // 4) AS edited FROM n), k AS (SELECT *, {kept('text')} AS h, {kept('edited')} AS eh, {kept('next_text')} AS nh FROM e),
p AS (SELECT *, {name('text', 'h')} AS fingerprint, {name('edited', 'eh')} AS edited_fingerprint, {name('next_text', 'nh')} AS next_fingerprint FROM k)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, {alike('edited_fingerprint', 'eh')} AS near_edited, {alike('next_fingerprint', 'nh')} AS near_next FROM p"""


def oracle_sql() -> dict[str, str]:
    """For doc_ids and page_ids that are unique, as the given tables have them."""
    return {
        "op1_source_mixing": _mixing_sql(),
        "op2_near_duplicates": _near_duplicates_sql(),
        "op4_url_filters": _urls_sql(),
        "op7_benchmark_decontamination": _contamination_sql(),
        "op9_chat_formatting": _chat_sql(),
        "op10_quality_rules": _quality_sql(),
        "op12_centroid_clustering": _clustering_sql(),
        "op13_document_fingerprints": _fingerprints_sql(),
    }
