"""Operators against brute force, round trips and held-out rows; nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lacuna.llm import bytecnn, hilbert, maxscore, minmax, mixing, secrets, tokenfile, toxicity, transducer, winnow
from lacuna.llm.components import components
from lacuna.llm.labelled import fit_on_labelled, fold
from lacuna.llm.texts import word_count
from lacuna.scratch import new_path

# names that operators use for their own columns ride along
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int, slot int, size int, "
          "taken int, row string, key string, id int, n int, start int, target string, copies int, hilbert int, items string")
CLASH = (0.5, 1, 2, 3, 4, "r", "k", 5, 6, 7, "t", 8, 9, "i")
WORDS = "The quick brown fox jumps over a lazy dog while seven Bright stars shine above the old stone bridge near our quiet town".split()


def document(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None, *CLASH)


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(n))


def awkward_rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    long = " ".join(prose(i, 500) for i in range(40))
    return [document(1, base), document(2, base, "de", None), document(3, " ".join(near), None, "s2"), document(4, None), document(5, ""),
            document(6, " \n\t "), document(7, "two words", source="s3"), document(7, "two words", source="s3"), document(None, "two words"),
            document(None, None, None, None), document(8, long), document(9, "é" * 3000 + " 東京 ßa'll x're <|endoftext|> 's"),
            document(10, prose(2, 60)), document(11, prose(2, 60) + " more"), document(12, "same same same same same same same same same same same same")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---------------------------------------------------------------- top-k

def brute_top_k(rows, k, step):
    clean = {(i, tuple(math.floor(8 * x) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in {i for i, _ in clean if i % step == 0}:
        best = {}
        for i, v in clean:
            for j, u in clean:
                if j == q and i != q:
                    best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(v, u)))
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims,n,k", [(6, 300, 5), (3, 40, 60), (12, 400, 20)])
def test_top_k(spark, monkeypatch, dims, n, k):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 64)
    draw = np.random.default_rng(dims)
    rows = [(i, draw.normal(size=dims).round(1).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [None] * dims), (n + 2, [math.nan] * dims), (n + 3, [math.inf] * dims), (None, [1.0] * dims), (n + 4, []),
             (n + 5, [0.0] * dims), rows[0], rows[7], (20, [2.0] * dims), (n + 6, [-3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = maxscore.top_k(maxscore.integer_vectors(df, "vec_id", "embedding", 8), F.col("key") % 10 == 0, k)
    assert collected(got, "query_id", "rank", "vec_id", "score") == sorted(brute_top_k(rows, k, 10), key=repr)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert maxscore.top_k(maxscore.integer_vectors(df, "vec_id", "embedding", 64), F.col("key") % 20 == 0, 20).count() == 0


def test_top_k_skips_rows():
    """A term that decides alone leaves the rows without it unvisited, and the result stays exact."""
    keys = np.arange(1000)
    matrix = np.zeros((1000, 4), np.int64)
    matrix[::10, 0] = 50
    matrix[:, 1:] = np.random.default_rng(0).integers(-1, 2, (1000, 3))
    ids, scores = maxscore.Postings(keys, matrix).search(-1, np.array([9, 1, 1, 1]), 5)
    want = sorted(((-int(s), i) for i, s in enumerate(matrix @ np.array([9, 1, 1, 1]))))[:5]
    assert list(zip((-scores).tolist(), ids.tolist())) == want


# ---------------------------------------------------------------- secrets

def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + content


def rsa_key():
    pick = random.Random(3)
    number = lambda n: der(2, b"\x01" + pick.randbytes(n))
    return der(0x30, der(2, b"\0") + b"".join(number(n) for n in (128, 2, 128, 64, 64, 64, 64, 64)))


def jwt(head, body):
    coded = [base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode() for x in (head, body)]
    return ".".join([*coded, "c2lnbmF0dXJlLWJ5dGVz"])


def test_secret_structures(spark):
    key = rsa_key()
    coded = base64.b64encode(key).decode()
    string = lambda b: len(b).to_bytes(4, "big") + b
    ssh = base64.b64encode(string(b"ssh-ed25519") + string(bytes(range(32)))).decode()
    good = {"jwt": jwt({"alg": "HS256"}, {"sub": 1}), "der": coded, "ssh": ssh,
            "pem": "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", coded)) + "\n-----END RSA PRIVATE KEY-----"}
    bad = [jwt({"typ": "JWT"}, {}), "aaaaaaaaaaaa.bbbbbbbbbb.cccccc", coded[:-8], base64.b64encode(bytes(90)).decode(),
           base64.b64encode(b"\x30" + bytes(range(1, 91))).decode(), "-----BEGIN RSA PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----"]
    rows = [document(i, f"é {s} .") for i, s in enumerate([*good.values(), key.hex(), *bad])]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (kind, s) in enumerate(good.items()):
        assert f"{kind}:2:{2 + len(s)}" in got[i].split(","), kind
    assert "der:" in got[4] and "hex:" in got[4]
    for i in range(5, 5 + len(bad)):
        assert not re.search("jwt|der|ssh|pem", got[i]), rows[i][1]
    assert secrets.redact(rows[0][1], got[0]) == "é [SECRET] ."


def test_tokens_end_before_a_full_stop(spark):
    signed, part = jwt({"alg": "HS256"}, {"sub": 1}), "c2lnbmF0dXJlLWJ5dGVz"
    head = base64.urlsafe_b64encode(json.dumps({"alg": "dir", "enc": "A256GCM"}).encode()).rstrip(b"=").decode()
    tokens = [signed, f"{head}.{part}.{part}.{part}.{part}", f"{head}..{part}.{part}.{part}"]
    texts = [(t, f"{a}{t}{b}", len(a)) for t in tokens for a, b in (
        ("token ", ". Next"), ("token ", "."), ("", ", then"), ('"', '"'), ("'", "'."), ("(", ")"), ("configuration.service.", " "), ("", "...\nNext"), ("", ""))]
    texts += [(None, f"{signed}.{part}.{part}", 0), (None, f"{signed}.{part}", 0), (None, f"{part}.{part}.{part}.{part}.{part}.", 0), (None, "somewhere... else", 0)]
    got = {r["doc_id"]: r["spans"].split(",") for r in secrets.scan(spark.createDataFrame([document(i, t) for i, (_, t, _) in enumerate(texts)], SCHEMA)).collect()}
    for i, (token, text, at) in enumerate(texts):
        assert [s for s in got[i] if s.startswith("jwt")] == ([f"jwt:{at}:{at + len(token)}"] if token else []), text


def test_secret_base_spans(spark, awkward, empty):
    texts = ["PassWord = 'abcdef' token:\"12345\" api_key=zzzzzz apikey==abcdef", "AKIA" + "A1" * 8 + " AKIASHORT akia" + "a" * 20, "0123456789abcdef01234567 " * 2,
             "ſecret=abcdef toKen=abcdef", "secret: token=abcdefgh", "password =  \n abcdef", ""]

    def brute(t):
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
            r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
            r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))

    got = secrets.scan(spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == {i: hashlib.sha256(brute(t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert secrets.scan(awkward).count() == len(awkward_rows()) and secrets.scan(empty).count() == 0


# ---------------------------------------------------------------- Hilbert order

def test_curve_visits_neighbours(spark):
    cells = [F.pmod(F.col("id"), F.lit(8)), F.pmod(F.floor(F.col("id") / 8), F.lit(8)), F.floor(F.col("id") / 64)]
    rows = spark.range(512).select(*[c.cast("int").alias(n) for c, n in zip(cells, "xyz")]).withColumn("h", hilbert.hilbert_index([F.col(n) for n in "xyz"], 3))
    path = [tuple(r)[1:] for r in sorted(tuple(r) for r in rows.select("h", "x", "y", "z").collect())]
    assert sorted(r[0] for r in rows.select("h").collect()) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards_of_awkward_rows(awkward, empty, shards):
    sized = awkward.withColumn("bytes", F.octet_length("text"))
    out = hilbert.hilbert_shards(sized, shards, ["lang", "source"], ["bytes"], ["doc_id"])
    counts = defaultdict(list)
    for r in out.collect():
        counts[r["shard"]].append(r["slot"])
    sizes = [len(counts[s]) for s in range(shards)]
    assert sum(sizes) == len(awkward_rows()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert set(out.columns) == {*sized.columns, "hilbert", "shard", "slot"}
    assert hilbert.hilbert_shards(empty, shards, ["lang"], ["n_chars"], ["doc_id"]).count() == 0


def test_shards_are_compact(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(32))).alias("source"),
                                    F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100000)).alias("size"))
    out = hilbert.hilbert_shards(rows, 16, ["source"], ["size"], ["doc_id"])
    spread = out.groupBy("shard").agg(F.countDistinct("source").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < 16  # half of the sources at most: a filter on one skips most files


def test_written_shards(spark, awkward, tmp_path):
    out = hilbert.hilbert_shards(awkward.withColumn("bytes", F.octet_length("text")), 3, ["lang"], ["bytes"], ["doc_id"])
    hilbert.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(awkward_rows())


# ---------------------------------------------------------------- winnowing

def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def test_winnowing(spark, awkward):
    items = [(1, prose(1, 120)), (10, prose(5, 30)), (2, "two words"), (3, None), (4, ""), (5, "Same same"), (6, prose(2, 9)), (7, prose(2, 10)), (8, prose(2, 5)),
             (9, prose(7, 40)), (9, prose(7, 40)), (None, prose(2, 20)), (11, "same " * 11), (12, "é東 ß"), (13, " ".join(prose(1, 120).split()[50:62]))]
    pick = random.Random(9)
    rows = awkward_rows() + [document(100 + i, f"{prose(100 + i, pick.randrange(30))}, {' '.join(prose(s, 40).split()[a : a + n]).upper()}! {prose(200 + i, pick.randrange(30))}")
                             for i, (s, a, n) in enumerate((pick.choice([5, 7, 1]), pick.randrange(20), pick.randrange(7, 25)) for _ in range(60))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, id int")
    got, spans = winnow.contamination(docs, benchmark)
    assert collected(got, "id", "n_words", "n_hit", "items") == brute_contamination([r[:2] for r in rows], items)
    assert spans.where("last <= first").count() == 0


def test_winnowing_of_nothing(spark, awkward, empty):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    got, _ = winnow.contamination(awkward, benchmark)
    assert got.count() == len(awkward_rows()) and got.where("n_hit > 0 or size(items) > 0").count() == 0
    assert winnow.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id bigint, text string"))[0].count() == 0


def test_every_long_window_is_kept():
    draw = np.random.default_rng(0)
    for _ in range(50):
        hashes = draw.integers(0, 6, 40).astype(np.uint64)  # many ties
        kept = set(winnow.kept_grams(hashes, 6).tolist())
        assert all(kept & set(range(i, i + 6)) for i in range(35))


# ---------------------------------------------------------------- mixing

def brute_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else weight[s] * rest / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark):
    pick = random.Random(4)
    rows = [(i, "w " * pick.randrange(0, 60), pick.choice(["a"] * 12 + ["b", "c", "ä", None, "Z"])) for i in range(1500)]
    rows += [(3, "w w", "a"), (3, "w w", "a"), (None, "w w w", "b"), (9999, None, "only empty"), (10000, "", None)]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id bigint, text string, source string, size int, target int").repartition(5)
    got = mixing.mix(df, "doc_id", word_count(F.col("text")), "source", [5, 2, 1]).select("doc_id", "mix.*").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, most = brute_targets(dict(sizes), [5, 2, 1], 3), Counter(), max(len((t or "").split()) for _, t, _ in rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= most for s in want)
    again = mixing.mix(df.repartition(2), "doc_id", word_count(F.col("text")), "source", [5, 2, 1]).select("doc_id", "mix.*").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_of_awkward_rows(awkward, empty):
    assert mixing.mix(awkward, "doc_id", word_count(F.col("text")), "source", [5, 2, 1]).count() == len(awkward_rows())
    assert mixing.mix(empty, "doc_id", word_count(F.col("text")), "source", [5, 2, 1]).count() == 0
    nothing = awkward.where("text is null or text = ''")
    assert mixing.mix(nothing, "doc_id", word_count(F.col("text")), "source", [5, 2, 1]).where("mix.taken <> 0 or mix.target <> 0").count() == 0


# ---------------------------------------------------------------- near duplicates

def test_mix_splits_repeated_keys(spark, tmp_path):
    """One key and one row without key, each a third of the rows, are taken in part; so is a source made of nothing else."""
    rows = [(7, f"{'w ' * 9}{i % 50}", "a") for i in range(300)] + [(None, "w " * 10, "a")] * 300 + [(1000 + i, "w " * 10, "a") for i in range(300)]
    rows += [(8, "w " * 10, "b")] * 400 + [(None, "w " * 10, "c")] * 400 + [(2000 + i, "w " * 10, "d") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    df.write.parquet(str(tmp_path / "rows"))
    size, results = word_count(F.col("text")), []
    for given in (df, spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "rows")).where("source is not null").select("source", "text", "doc_id")):
        got = mixing.mix(given, "doc_id", size, "source", [50, 7, 5, 31]).select("doc_id", "text", "mix.*").collect()
        assert len(got) == len(rows)
        target, taken = {r["source"]: r["target"] for r in got}, Counter()
        for r in got:
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 5 for s in target), (target, taken)
        assert all(len({r["copies"] for r in got if r["source"] == s}) == 2 for s in "bc")
        results.append(sorted(repr((r["doc_id"], r["text"], r["source"], r["copies"])) for r in got))
    assert results[0] == results[1]  # the third has its columns in another order


def brute_groups(rows, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        ids[root(i)].append(k)
    least = {r: min((k for k in v if k is not None), default=None) for r, v in ids.items()}
    return sorted(((k, len(s), least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr), len(ids)


@pytest.mark.parametrize("percent,block", [(85, 400_000), (80, 1500)])
def test_near_duplicates(spark, monkeypatch, percent, block):
    monkeypatch.setattr(minmax, "BLOCK_SHINGLES", block)  # small blocks: clusters are compared in parts
    pick = random.Random(percent)
    rows = [r[:2] for r in awkward_rows()]
    for g in range(12):
        base = prose(50 + g, pick.choice([6, 30, 150])).split()
        for c in range(14):
            words = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 3, 6])):
                words[pick.randrange(len(words))] = f"x{pick.randrange(1000)}"
            rows.append((1000 + 20 * g + c, " ".join(words)))
    df = spark.createDataFrame([document(i, t) for i, t in rows], SCHEMA).repartition(4)
    groups, table = minmax.near_duplicates(df, percent=percent)
    want, count = brute_groups(rows, percent)
    assert collected(groups, "key", "n_shingles", "component_id") == want
    assert groups.where("first").count() == count
    assert table.columns == [*df.columns, "__row"]


def test_deduplicate(awkward, empty):
    kept = minmax.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [1, 4, 5, 6, 7, None, 8, 9, 10, 12]))
    assert minmax.deduplicate(empty).count() == 0


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(pick.randrange(300, 500), pick.randrange(300, 500)) for _ in range(150)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    parent = {}
    for a, b in edges:
        minmax.join_nodes(parent, a, b)
    want = {n: minmax.roots_of(parent, n) for n in parent}
    assert {r["node"]: r["root"] for r in components(df).collect()} == {n: r for n, r in want.items() if n != r}
    assert components(df.where("false")).count() == 0


def test_bands_meet():
    """Nearly all sets at the limit share a band; the estimate behind the parameters holds for these hashes."""
    a, b = minmax.permutations()
    draw, met = np.random.default_rng(1), 0
    for _ in range(150):
        union = winnow.mixed(draw.integers(0, 1 << 63, 200).astype(np.uint64))
        met += bool(np.any(minmax.band_keys(union[:185], a, b) == minmax.band_keys(union[15:], a, b)))  # 170 of 200 in common
    assert met == 150


# ---------------------------------------------------------------- classifiers

def test_network_gradients():
    net = bytecnn.ByteNet(3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    batch = [bytecnn.padded(prose(i, 30 * i)) for i in range(4)]
    labels = np.array([0, 1, 1, 0])

    def loss():
        p = net.head(np.stack([np.concatenate([c.mean(0), c.max(0), c.min(0)]) for c in map(net.responses, batch)]))[1]
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    got = net.gradients(batch, labels)
    for name, at in (("out", (2, 0)), ("hidden", (40, 3)), ("prior", (0, 0)), ("filters", (5, 7)), ("embed", (ord("e"), 1))):
        kept, step = net.weights[name][at], 1e-3
        values = []
        for d in (step, -step):
            net.weights[name][at] = kept + d
            values.append(loss())
        net.weights[name][at] = kept
        assert got[name][at] == pytest.approx((values[0] - values[1]) / (2 * step), rel=0.25, abs=4e-3), name


def test_network_covers_whole_texts(monkeypatch):
    net, text = bytecnn.ByteNet(1), "é".join(prose(i, 400) for i in range(6))
    whole = net.features(text)
    monkeypatch.setattr(bytecnn, "SPAN", 1000)
    assert np.allclose(net.features(text), whole, atol=1e-5)
    assert not np.allclose(net.features(text + " ###!!###"), whole)
    assert np.isfinite(net.score(["", "a", text])).all()


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = (label == 1).sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


@pytest.mark.parametrize("run,label,least", [(bytecnn.quality, "quality", 0.85), (toxicity.toxicity, "toxic", 0.8)])
def test_held_out_rows(spark, run, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = run(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and got["score"].between(0, 1).all()
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) > least


@pytest.mark.parametrize("run,label", [(bytecnn.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_on_awkward_rows(spark, awkward, empty, run, label):
    labels = spark.createDataFrame([], f"doc_id bigint, {label} int")
    got = run(awkward, labels).collect()
    assert len(got) == len(awkward_rows()) and {r["score"] for r in got} == {0.5}
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1, 13)}
    one = spark.createDataFrame([(1, 1), (3, 1), (4, None), (None, 0), (77, 0)], f"doc_id bigint, {label} int")
    assert all(0.5 <= r["score"] < 1 for r in run(awkward, one).collect())
    two = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], f"doc_id bigint, {label} int")
    assert all(0 <= r["score"] <= 1 for r in run(awkward, two).collect())
    assert run(empty, two).count() == 0


def test_held_out_labels_are_never_read(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id bigint, toxic int")
    other = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert collected(toxicity.toxicity(awkward, labels), "doc_id", "score") == collected(toxicity.toxicity(awkward, other), "doc_id", "score")


def test_long_texts_leave_the_sample_whole(spark):
    """The first keys of the order have texts of more than the bound, or of a large part of it."""
    ids = sorted((i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    long = {ids[0]: 2000, ids[1]: 900, ids[3]: 70}
    docs = spark.createDataFrame([(i, "x" * long.get(i, 20)) for i in ids], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in [*ids, *range(1000, 1050)]], "doc_id bigint, quality int")
    given = lambda rows, most: fit_on_labelled(docs, labels, "quality", rows, most, lambda x: {"n": x})["n"]
    left = [("x" * 20, i % 2) for i in ids if i not in long]
    assert given(30, 1000) == left[:30]
    assert given(1000, 400) == left[:20]
    with pytest.raises(ValueError, match="every labelled text"):
        given(30, 100)


def test_a_repeated_key_is_one_text_of_the_sample(spark):
    """The first key of the order holds most rows, of documents and of labels."""
    ids = sorted((i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(i, f"text {i:14}") for i in ids] + [(ids[0], f"other {i:13}") for i in range(100)] + [(ids[0], f"text {ids[0]:14}")] * 100
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), [(i, i % 2) for i in ids] + [(ids[0], ids[0] % 2)] * 50
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    given = [fit_on_labelled(docs.repartition(n), labels, "quality", 20, 10_000, lambda x: {"n": x})["n"] for n in (2, 5)]
    assert given[0] == given[1] and len(given[0]) == 20
    assert given[0][1:] == [(f"text {i:14}", i % 2) for i in ids[1:20]] and (ids[0], given[0][0][0]) in rows


@pytest.mark.parametrize("word", ["SHOUT", "ÄRGER", "ΘΥΜΟΣ", "ГНЕВ"])
def test_capitals_count_alike_at_every_size(word):
    features = toxicity.Features({})
    for text in (f"{word} now", f"{word} now " * 20):
        of = dict(zip(toxicity.FEATURES, features.of(text)))
        assert of["capitals"] == pytest.approx(len(word) * text.count(word) / len(text)) and of["shouted"] == 0.5


def test_calibration_rises():
    draw = np.random.default_rng(0)
    margin = draw.normal(size=500).round(1)
    at, value = toxicity.isotonic(margin, (draw.random(500) < 1 / (1 + np.exp(-margin))).astype(float))
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] and value[-1] < 1


# ---------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    pick = random.Random(0)
    letters = "aestmdrvl''  \n\t1²٣é.!€　\x1cć字x  ÀΩ\U00016ea0"
    made = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    return made + ["<|endoftext|>", "a<|endoftext|>'ll <|endoftext|>", "'l", "'r", "x'", "  ", "\n\n 'S", "It's 'e don't we've you'rex I'll'll", "z" * 5000, " " * 3000, "'" * 999]


def test_token_counts(spark, byte_bpe, awkward, empty):
    texts = odd_texts()
    df = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], SCHEMA)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in transducer.token_counts(df, path).collect()}
    want = [len(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]
    assert got == {i: (len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, want))}
    nothing = transducer.token_counts(awkward.where("text is null"), path).collect()
    assert {(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in nothing} == {(0, 0, False)}
    assert transducer.token_counts(empty, path).count() == 0


def test_scan_of_maps_is_composition():
    draw = np.random.default_rng(0)
    maps = draw.integers(0, 9, (37, 9)).astype(np.uint8)
    want = [maps[0]]
    for m in maps[1:]:
        want.append(m[want[-1]])
    assert (transducer.prefix_maps(maps) == np.stack(want)).all()


def test_chunks_do_not_matter(byte_bpe, monkeypatch):
    classes = transducer.character_classes(byte_bpe)
    after, out = transducer.cutting_machine()
    text = classes[np.frombuffer("".join(odd_texts()).encode("utf-32-le"), np.uint32)]
    whole = transducer.cuts(text, after, out)
    for n in (1, 3, 64):
        monkeypatch.setattr(transducer, "CHUNK", n)
        assert (transducer.cuts(text, after, out) == whole).all()


def test_rank_coding():
    draw = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (draw.integers(0, 1 << 32, n) >> draw.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (tokenfile.decode_ranks(control, data, n) == ranks).all()


def test_token_files(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 200)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = awkward_rows() + [document(100 + i, t) for i, t in enumerate(odd_texts()[::20])] + [document(2000, "<|endoftext|> x<|startoftext|>y"), document(2001, "e ́ é a\x85b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    place = new_path(spark, "test-tokens")
    tokenfile.write_token_files(df, place, path)
    got = tokenfile.read_token_files(spark, place).orderBy("start").collect()
    want = sorted((-1 if i is None else i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows)
    assert [(-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == \
        sorted(want, key=lambda x: (x[0], np.array(x[1], "<u2").tobytes()))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    place = new_path(spark, "test-tokens")
    tokenfile.write_token_files(empty, place, path)
    assert tokenfile.read_token_files(spark, place).count() == 0
