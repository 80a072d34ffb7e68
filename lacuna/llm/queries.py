"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna.llm import bytecnn, conversations, hilbert, maxscore, minmax, mixing, negatives, secrets, suffixes, tokenfile, toxicity, transducer, winnow
from lacuna.llm.texts import word_count
from lacuna.scratch import new_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


TOP_K, SCALE, QUERY_STEP = 20, 64, 20


@query("op1_maxscore_top_k", f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP_K}""")
def op1(spark, folder):
    vectors = maxscore.integer_vectors(read(spark, folder, "embeddings"), "vec_id", "embedding", SCALE)
    return maxscore.top_k(vectors, F.col("key") % QUERY_STEP == 0, TOP_K)


@query("op2_secret_structures")
def op2(spark, folder):
    return secrets.scan(read(spark, folder, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
                                                                 "n_jwt", "n_pem", "n_der", "n_ssh", "n_public")


SHARDS = 24


# the CRC is folded bit by bit, the curve step by step over (bit, dimension)
@query("op3_hilbert_shards", f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, lang, source, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS MATERIALIZED (SELECT row, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) AS crc FROM d),
lc AS (SELECT v, floor((row_number() OVER (ORDER BY v) - 1) * 256 / greatest(count(*) OVER (), 256))::BIGINT AS cell FROM (SELECT DISTINCT lang AS v FROM d WHERE lang IS NOT NULL)),
sc AS (SELECT v, floor((row_number() OVER (ORDER BY v) - 1) * 256 / greatest(count(*) OVER (), 256))::BIGINT AS cell FROM (SELECT DISTINCT source AS v FROM d WHERE source IS NOT NULL)),
p AS (SELECT row, [coalesce(lc.cell, 0), coalesce(sc.cell, 0), least((length(bin(size + 1)) - 1) * 8 + (((size + 1) << 3) >> (length(bin(size + 1)) - 1)) % 8, 255)]::BIGINT[] AS p
  FROM d LEFT JOIN lc ON lc.v = lang LEFT JOIN sc ON sc.v = source),
u AS (SELECT row, list_reduce(list_concat([p], list_transform(range(0, 21), lambda n: [128 >> (n // 3), n % 3 + 1, 0]::BIGINT[])), lambda x, s:
  [CASE WHEN x[s[2]] & s[1] <> 0 THEN xor(x[1], s[1] - 1) ELSE xor(x[1], xor(x[1], x[s[2]]) & (s[1] - 1)) END,
   CASE WHEN s[2] <> 2 OR x[2] & s[1] <> 0 THEN x[2] ELSE xor(x[2], xor(x[1], x[2]) & (s[1] - 1)) END,
   CASE WHEN s[2] <> 3 OR x[3] & s[1] <> 0 THEN x[3] ELSE xor(x[3], xor(x[1], x[3]) & (s[1] - 1)) END]::BIGINT[]) AS x FROM p),
g AS (SELECT row, [x[1], xor(x[2], x[1]), xor(x[3], xor(x[2], x[1]))] AS g FROM u),
f AS (SELECT row, list_transform(g, lambda x: xor(x, list_reduce(list_concat([0::BIGINT], list_transform(range(0, 7), lambda n: 128::BIGINT >> n)),
  lambda t, q: CASE WHEN g[3] & q <> 0 THEN xor(t, q - 1) ELSE t END))) AS f FROM g),
h AS (SELECT row, list_sum(list_transform(range(0, 24), lambda n: ((f[n % 3 + 1] >> (7 - n // 3)) & 1) << (23 - n)))::BIGINT AS hilbert FROM f),
o AS (SELECT doc_id, size, crc, hilbert, row_number() OVER (ORDER BY hilbert, crc, doc_id NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM d JOIN c USING (row) JOIN h USING (row))
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'rows' AS law, (pos * {SHARDS} // n)::INTEGER AS shard,
  (pos - ((pos * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, hilbert FROM o""")
def op3(spark, folder):
    base = hilbert.measured(read(spark, folder, "documents"), "doc_id", "text", "lang", "source")
    out = hilbert.hilbert_shards(base, SHARDS, ["lang", "source"], ["size"], ["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hilbert")


WEIGHTS, EPOCHS = [5, 2, 1], 3

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op4_winnowing", f"""
WITH d AS MATERIALIZED (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
ix AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM iw),
t AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM ix),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n),
h AS MATERIALIZED (SELECT doc_id, p, dp.n, item_id FROM dp JOIN t ON dp.n = t.n AND array_to_string(dp.w[p:p + dp.n - 1], ' ') = t.s),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op4(spark, folder):
    documents, _ = winnow.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return documents.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                            (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_capped_water_filling", f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, {EPOCHS} * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS k FROM w),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level, k FROM c WHERE cap >= weight * level ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k < coalesce((SELECT k FROM l), 1e18) THEN cap::DOUBLE
  ELSE least(cap::DOUBLE, weight * (SELECT level FROM l)) END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, greatest(0.0, target - whole * source_size) AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('0|' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, (whole + CASE WHEN middle <= rest AND whole < {EPOCHS} THEN 1 ELSE 0 END)::INTEGER AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM x""")
def op5(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, "doc_id", word_count(F.col("text")), "source", WEIGHTS, EPOCHS).select("doc_id", "mix.*")


@query("op6_byte_cnn")
def op6(spark, folder):
    return bytecnn.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op7_min_max_hashing", """
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(d, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.t),
m AS (SELECT d, min(t) AS t FROM r GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, t AS component_id, doc_id = t AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.d = doc_id""")
def op7(spark, folder):
    groups, _ = minmax.near_duplicates(read(spark, folder, "documents"))
    return groups.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


@query("op8_boosted_toxicity")
def op8(spark, folder):
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op9_token_counts")
def op9(spark, folder):
    return transducer.token_counts(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op10_token_files")
def op10(spark, folder):
    path = new_path(spark, "token-files")
    tokenfile.write_token_files(read(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"), end=1)
    return tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut off, repeated or given to the user, as a CRC of their place decides."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


# all edits of all rows, one row after the other: the least cost and letters of each of the four states
def _paid(x: str, cost, letter: str) -> str:
    """SQL of a state's cost (six digits) and letters after one more edit; '~' is a state not reached."""
    return f"CASE WHEN {x} = '~' THEN '~' ELSE lpad((substr({x}, 1, 6)::INTEGER + {cost})::VARCHAR, 6, '0') || substr({x}, 7) || '{letter}' END"


_INSERTED = ("[s[1], s[2], least(s[3], " + ", ".join(_paid(f"s[{i}]", 3, "I") for i in (1, 2, 4)) + "), least(s[4], " + _paid("s[3]", 3, "I") + ")]")
_EXTRA = "(CASE WHEN r[2] = 'cut' THEN 3 ELSE 0 END)"


def _stays(letter: str, states: list[int], initial: str | None = None) -> str:
    ok = "r[2] <> 'gone'" + (f" AND r[1] = '{initial}'" if initial else "")
    cost = _EXTRA if letter == "K" else f"3 + {_EXTRA}"
    return ", ".join(f"CASE WHEN {ok} THEN {_paid(f'b[{s}]', cost, letter)} ELSE '~' END" for s in states)


_ROW = ("[" + _paid("b[1]", 4, "D") + ", "
        + "least(" + _paid("b[2]", 4, "D") + ", " + _stays("K", [1], "s") + "), "
        + "least(" + _paid("b[3]", 4, "D") + ", " + _stays("K", [1, 2, 4], "u") + ", " + _stays("R", [1, 2, 4]) + "), "
        + "least(" + _paid("b[4]", 4, "D") + ", " + _stays("K", [3], "a") + ", " + _stays("R", [3]) + ")]")


@query("op11_hirschberg_repair", f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
x AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(place)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 20 AS fate FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE fate <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
t AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM o),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM t),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts,
  list([left(role, 1), CASE WHEN fault IN ('blank', 'duplicate') THEN 'gone' WHEN fault = 'truncated' THEN 'cut' ELSE '' END] ORDER BY n) AS codes FROM f GROUP BY conv_id),
e AS (SELECT *, list_reduce(list_concat([['000000', '~', '~', '~']], codes), lambda s, r: list_transform([{_INSERTED}], lambda b: {_ROW})[1]) AS s FROM c),
b AS (SELECT *, least(s[1], {_paid("s[2]", 6, "II")}, {_paid("s[3]", 3, "I")}, s[4]) AS best FROM e),
a AS (SELECT *, substr(best, 1, 6)::BIGINT AS cost, substr(best, 7) AS audit FROM b),
w AS (SELECT *, list_reduce(list_concat([['0', '1', '', '']], list_transform(regexp_extract_all(audit, '.'), lambda l: [l, '', '', ''])),
  lambda p, l: CASE WHEN l[1] = 'D' THEN [p[1], (p[2]::INTEGER + 1)::VARCHAR, p[3], p[4]] ELSE
    list_transform([CASE WHEN l[1] = 'K' THEN roles[p[2]::INTEGER] WHEN p[1] = 'u' THEN 'assistant' ELSE 'user' END], lambda role:
      [left(role, 1), (p[2]::INTEGER + CASE WHEN l[1] = 'I' THEN 0 ELSE 1 END)::VARCHAR, p[3] || p[4] || role || ':' || CASE WHEN l[1] = 'I' THEN '' ELSE texts[p[2]::INTEGER] END, chr(10)])[1] END) AS done FROM a)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(done[3], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id""")
def op11(spark, folder):
    rows = read(spark, folder, "conversations")
    report, repaired = conversations.repair(damaged(rows))
    digests = conversations.joined_digest(repaired).withColumnRenamed("key", "k")
    all_ids = rows.select("conv_id").distinct()
    out = (all_ids.join(report, F.col("conv_id").eqNullSafe(F.col("key")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("k")), "left"))
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


ANCHOR_STEP, NOISE_STEP, CLASSES = 100, 7, 10
LABEL = f"CASE WHEN vec_id % {NOISE_STEP} = 0 THEN (label + 1) % {CLASSES} ELSE label END"


@query("op12_kronecker_negatives", f"""
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, ({LABEL})::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_dot_product(a.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE label = own),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE place <= 5 AND label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10""")
def op12(spark, folder):
    vectors = negatives.labelled_vectors(read(spark, folder, "embeddings"), "vec_id", "embedding", F.expr(LABEL), 256)
    return negatives.hard_negatives(vectors, F.col("key") % ANCHOR_STEP == 0, positives=5, negatives=10, least=30, most=90)


@query("op13_suffix_array_dedup", """
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, length(h) // 2 AS n, unnest(range(0, length(h) // 2 - 99)) AS p, h FROM d WHERE length(h) >= 200),
m AS (SELECT row, p, md5_number(substr(h, 2 * p + 1, 200)) AS m FROM w),
r AS (SELECT row, p FROM m QUALIFY row_number() OVER (PARTITION BY m ORDER BY row, p) > 1),
e AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY row ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY p) AS run FROM e),
s AS (SELECT row, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY row, run),
k AS (SELECT row, sum(b - a) AS n_removed, count(*) AS n_spans, list([a, b] ORDER BY a) AS spans FROM s GROUP BY row),
c AS (SELECT d.*, n_removed, n_spans, list_concat([[0, 0]], coalesce(spans, []), [[length(h) // 2, length(h) // 2]]) AS cuts FROM d LEFT JOIN k USING (row))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(cuts)), lambda i: substr(h, 2 * cuts[i][2] + 1, 2 * (cuts[i + 1][1] - cuts[i][2]))), ''))) AS kept_sha256 FROM c""")
def op13(spark, folder):
    out = suffixes.remove_repeats(read(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
