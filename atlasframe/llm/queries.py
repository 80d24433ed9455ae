"""The registered query of each operator, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, licenses, linededup, media, mixing, packing, periodic, sharding, simhash, tokencount, topk, whitening
from .common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the runs of lines that occurred before."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an MPEG audio stream, and what is read back from it."""
    found = media.read(media.store(_table(spark, sf_dir, "documents")))
    last = F.element_at("offsets", -1)
    feature = F.format_string("mpeg%s layer%d %d Hz frames=%d samples=%d seconds=%d/%d kbps=%.3f %s=%d crc=%d-%d skipped=%d last=%d", "version", "layer", "rate", "frames", "samples", "seconds_num", "seconds_den", "kbps_mean", "vbr", "vbr_frames", "checked", "failed", "skipped", last)
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op4_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its slot there: equal texts together, counts at most one apart."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled documents outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"))
    languages = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), languages).select("doc_id", "held_out", "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates that every document contains."""
    listed = F.array(*[F.struct(F.lit(k).alias("template_id"), F.lit(v).alias("text")) for k, v in licenses.TEMPLATES.items()])
    templates = spark.range(1).select(F.inline(listed))
    return licenses.scan(_table(spark, sf_dir, "documents"), templates).select("doc_id", "template_id", "matched", "shingles")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 of control strings, as read back from its formatted string."""
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_turns(chat.canonical_turns(chat.conversations_as_records(rows), "record"))
    back = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("back"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["learn"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when at first (in billionths of the training time)."""
    sizes = written(_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_of().alias("size")))  # texts are read once
    mixed = mixing.mix(sizes, size_col="size")
    taken = (F.col("_mix_size") * F.col("_mix_times")).alias("taken")
    rows = mixed.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), taken, F.round(F.get("_mix_positions", F.lit(0)) * 1e9).cast("long").alias("first_position"))
    return rows.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every vector whose id is divisible by 20."""
    vectors = topk.impact_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of 3-word shingles and its component at 2 differing bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=2, words_per_shingle=3)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and whether these are over 2048."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def repeating_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each document whose id's crc32 ends in 0 is made to repeat its words from some place on.
    Documents without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    sized = split.select("*", F.when(F.col("words").isNotNull() & (F.size("words") > 0), F.size("words")).alias("n"))
    placed = sized.select("*", (F.col("g") % F.col("n")).cast("int").alias("a"))
    dealt = placed.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return dealt.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(repeated).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words, and the text without the repetitions."""
    found = periodic.collapse_runs(repeating_documents(_table(spark, sf_dir, "documents")))
    better = lambda best, r: F.when(best["length"].isNull() | (r["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    digest = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"), F.sha2(digest, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exact = F.expr("1000 * best.length div best.period")
    return best.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's coordinates along the 16 largest components of the distinct vectors, each of variance one."""
    vectors = whitening.integer_vectors(_table(spark, sf_dir, "embeddings"))
    rows = whitening.whiten(vectors, whitening.fit(vectors, 16))
    each = rows.select(F.col("id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select("vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("_at")).alias("explained"), "identity_error")


def _license_sql() -> str:
    """The scan without bands: the same windows, each held against every template."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    shingled = """SELECT {ids}, least(5, len(w)) AS size, i - 1 AS place, list_aggregate(w[i:i + {size} - 1], 'string_agg', ' ') AS h
  FROM (SELECT *, unnest(range(1, greatest(0, len(w) - {size} + 1) + 1)) AS i FROM {table})"""
    return f"""
WITH templates AS (
  SELECT template_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {quoted}) t(template_id, text)),
t AS ({shingled.format(ids="template_id", size="least(5, len(w))", table="templates")}),
sized AS (
  SELECT template_id, count(DISTINCT h) AS shingles, CAST(pow(2, ceil(log2(count(DISTINCT h)))) AS BIGINT) AS step FROM t GROUP BY template_id),
split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents),
d AS ({shingled.format(ids="doc_id", size=5, table="split")} UNION ALL
  {shingled.format(ids="doc_id", size=3, table="split")}),
placed AS (
  SELECT doc_id, template_id, h, place // step - back AS win, shingles
  FROM d JOIN (SELECT DISTINCT template_id, h FROM t) u USING (h) JOIN sized USING (template_id), (VALUES (0), (1)) b(back)),
counted AS (
  SELECT doc_id, template_id, win, count(DISTINCT h) AS matched, shingles FROM placed GROUP BY doc_id, template_id, win, shingles)
SELECT doc_id, template_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(shingles) AS INTEGER) AS shingles
FROM counted WHERE matched * 10 >= shingles * 8 GROUP BY doc_id, template_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_media_columns": op3_media_columns,
    "op4_balanced_sharding": op4_balanced_sharding,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_exact_topk": op9_exact_topk,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, k - 1 AS line_no, string_split(text, chr(10))[k] AS raw,
         trim(string_split(text, chr(10))[k], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)),
counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines WHERE line <> ''),
summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM counted),
pairs AS (
  SELECT a.doc_id, a.line_no AS p, min(b.line_no) AS e FROM summed a JOIN summed b
  ON a.doc_id = b.doc_id AND b.line_no >= a.line_no AND b.upto - a.upto + a.words >= 50 GROUP BY a.doc_id, a.line_no
  UNION
  SELECT b.doc_id, max(a.line_no) AS p, b.line_no AS e FROM summed a JOIN summed b
  ON a.doc_id = b.doc_id AND b.line_no >= a.line_no AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.line_no),
contents AS (
  SELECT w.doc_id, w.p, w.e, string_agg(s.line, chr(10) ORDER BY s.line_no) AS content
  FROM pairs w JOIN summed s ON s.doc_id = w.doc_id AND s.line_no BETWEEN w.p AND w.e GROUP BY w.doc_id, w.p, w.e),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS nth FROM contents),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, e + 1)) AS line_no FROM ordered WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL) AS text,
         count(*) AS n_lines, count(g.line_no) AS removed_lines
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op8_curriculum_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS begun,
         CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST(rank % 3 AS INTEGER) + 1] AS DOUBLE) AS w, sum(s) OVER () * CAST(1.5 AS DOUBLE) AS whole FROM sources),
levels AS (
  SELECT a.source, a.s, a.w, a.rank, (SELECT max(l) FROM (
      SELECT (max(c.whole) - coalesce(sum(2 * c.s) FILTER (WHERE 2 * c.s / c.w <= b.x), 0)) / sum(c.w) FILTER (WHERE 2 * c.s / c.w > b.x) AS l, b.x
      FROM (SELECT CAST(0 AS DOUBLE) AS x UNION SELECT 2 * s / w FROM weighed) b, weighed c GROUP BY b.x) t
    WHERE l >= x) AS level FROM weighed a),
targets AS (
  SELECT source, least(2 * s, w * level) AS target, rank FROM levels),
taken AS (
  SELECT p.doc_id, p.size, p.source_size, t.target, t.rank % 3 AS turn, (p.begun + p.size / 2) / t.target AS part,
         p.size * greatest(0, least(2, CAST(floor((t.target - p.begun - p.size / 2) / nullif(p.source_size, 0)) AS BIGINT) + 1)) AS taken
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
timed AS (
  SELECT *, CASE WHEN taken IS NULL OR taken = 0 THEN NULL
    WHEN turn = 0 THEN 2 * part / (sqrt(CAST(2.25 AS DOUBLE) - 2 * part) + 1.5)
    WHEN turn = 2 THEN 2 * part / (sqrt(CAST(0.0625 AS DOUBLE) + 3 * part) + 0.25)
    WHEN part * CAST(1.125 AS DOUBLE) <= 0.5 THEN 2 * part * CAST(1.125 AS DOUBLE) / (sqrt(CAST(0.25 AS DOUBLE) + 4 * part * CAST(1.125 AS DOUBLE)) + 0.5)
    ELSE 0.5 + 2 * (part * CAST(1.125 AS DOUBLE) - 0.5) / (sqrt(CAST(2.25 AS DOUBLE) - 2 * (part * CAST(1.125 AS DOUBLE) - 0.5)) + 1.5) END AS time FROM taken)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, CAST(round(time * 1000000000) AS BIGINT) AS first_position FROM timed
""",
    "op9_exact_topk": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(64 AS DOUBLE) * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op6_license_scan": _license_sql(),
    "op7_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, role = 'assistant' AS learn,
    length(regexp_replace(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')) + 1
    + length(regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 22 END AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE learn), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE learn), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
}
