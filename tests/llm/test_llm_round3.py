"""Conversation repair, hard negatives and repeated strings against brute force, with the awkward rows of each."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from lacuna.llm import bytecnn, conversations, minmax, negatives, queries, secrets, suffixes, tokenfile, toxicity, transducer
from lacuna.llm.texts import bitmap, with_passed
from test_llm_operators import rsa_key

# ---------------------------------------------------------------- conversations

TAKES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """All counts and the least of the cheapest edits, by trying every edit at every row; up to four rows put in at a place."""
    def with_inserts(held):
        held = dict(held)
        for _ in range(4):
            for state, (cost, audit, text) in list(held.items()):
                for role in ("user", "assistant"):
                    to = TAKES.get((state, role[0]))
                    option = (cost + 3, audit + "I", (*text, f"{role}:"))
                    if to is not None and (to not in held or option < held[to]):
                        held[to] = option
        return held

    held, seen, counts = {0: (0, "", ())}, set(), dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        after = {}
        for state, (cost, audit, said) in with_inserts(held).items():
            options = [(state, (cost + 4, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                options.append((TAKES.get((state, role[:1])), (cost + extra, audit + "K", (*said, f"{role}:{text}"))))
                options += [(TAKES.get((state, new[0])), (cost + 3 + extra, audit + "R", (*said, f"{new}:{text}"))) for new in ("user", "assistant")]
            for to, option in options:
                if to is not None and (to not in after or option[:2] < after[to][:2]):
                    after[to] = option
        held = after
    cost, audit, said = min((o for s, o in with_inserts(held).items() if s in (0, 3)), key=lambda o: o[:2])
    turns, initials = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts, "cost": cost, "audit": audit,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest()}


def damaged(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        said[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in said.items()}


def awkward_conversations():
    pick, rows = random.Random(7), []
    roles, texts = ["user", "assistant", "system", "tool", None, "", "user"], ["Yes.", "No", "", " \n", None, "Why? ", "One.\x0b", "é!"]
    for conv in [*range(400), None]:
        turns = pick.sample(range(60), pick.randrange(1, 12))
        rows += [(conv, t if pick.random() < 0.97 or i else None, pick.choice(roles), pick.choice(texts)) for i, t in enumerate(turns)]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"{'word ' * 3000}{t}.") for t in range(200)]  # long
    rows += [(1001, 2 * t, "user", "Same.") for t in range(150)] + [(1002, None, "user", "Hello.")]
    return rows


def saved(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_repair_equals_trying_all_edits(spark, tmp_path):
    rows = awkward_conversations()
    folder = saved(spark, tmp_path, rows, "conv_id bigint, turn bigint, role string, text string", "conversations")
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op11(spark, folder).collect()}
    want = damaged(rows)
    assert got.keys() == {r[0] for r in rows}
    for conv, found in got.items():
        assert found == cheapest(want[conv]), conv


@pytest.mark.parametrize("piece", [1, 3, 16])
def test_pieces_of_a_conversation_meet(spark, piece):
    """One conversation with most rows, cut into pieces, gives what it gives whole; its rows stay in order."""
    pick = random.Random(piece)
    rows = [(1, t, pick.choice(["user", "assistant", "system", "user"]), pick.choice(["Yes.", "No", f"{t}.", " ", "x!"])) for t in range(120) if pick.random() < 0.9]
    rows += [(2, 1, "user", "Hi."), (2, 1, "user", "Hi."), (2, 1, "user", "Hi."), (2, 3, "assistant", "Ho.")]
    frame = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, audit string, key int").repartition(4)
    report, said = conversations.repair(frame, piece=piece)
    digests = {r["key"]: r["sha256"] for r in conversations.joined_digest(said).collect()}
    got = {r["key"]: r.asDict() for r in report.collect()}
    for conv in (1, 2):
        want = cheapest([r[1:] for r in rows if r[0] == conv])
        found = {**got[conv], "repaired_sha256": digests.get(conv, hashlib.sha256(b"").hexdigest())}
        assert {k: found[k] for k in want} == want
    places = defaultdict(list)
    for r in said.collect():
        places[r["key"]].append(r["position"])
    assert all(p == list(range(len(p))) for p in places.values())


def test_repair_of_nothing(spark, tmp_path):
    folder = saved(spark, tmp_path, [], "conv_id bigint, turn bigint, role string, text string", "conversations")
    assert queries.op11(spark, folder).collect() == []


def test_crossings_give_the_least_letters():
    """Hirschberg's halves against all edits, on short rows of codes between all states."""
    pick, steps = random.Random(3), conversations.Steps()
    for _ in range(300):
        codes = bytes(pick.randrange(12) for _ in range(pick.randrange(1, 9)))
        for source in range(4):
            held = {source: (0, "")}
            for code in codes:
                after = {}
                for state, (cost, letters) in held.items():
                    for to, (more, added) in conversations.EDITS[code][state].items():
                        after[to] = min(after.get(to, (math.inf, "")), (cost + more, letters + added))
                held = after
            for target, (_, letters) in held.items():
                assert conversations.solve(codes, source, target, steps) == letters


# ---------------------------------------------------------------- hard negatives

def mined(rows, step, noise, classes, scale):
    kept = set()
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.add((key, (label + 1) % classes if key % noise == 0 else label, tuple(math.floor(scale * x) for x in vector)))
    out = []
    for key, label, vector in sorted(kept):
        if key % step:
            continue
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), k, l) for k, l, v in kept if k != key)
        for minus, positive, _ in [s for s in scores if s[2] == label][:5]:
            fit = [s for s in scores if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:10]
            out += [(key, positive, i + 1, k, -minus, -s) for i, (s, k, _) in enumerate(fit)]
    return sorted(out)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, key int, row int, rank string").repartition(4)


@pytest.mark.parametrize("spread", [1.0, 1e3, 1e6])
def test_hard_negatives_equal_all_products(spark, spread, monkeypatch):
    """Fields of two in a double, of one, and in Python's integers; ties, repeats, nulls, unequal lengths, many shards."""
    monkeypatch.setattr(negatives, "LEAST_ROWS", 16)
    r = np.random.default_rng(5)
    rows = [(i, (np.round(r.normal(size=6), 1) * spread + 0.5 * spread).tolist(), int(r.integers(0, 4))) for i in range(240)]
    rows += [(i + 240, rows[i][1], rows[i][2]) for i in range(0, 120)] + rows[:7]  # equal vectors, equal rows
    rows += [(None, rows[0][1], 1), (500, None, 1), (501, [1.0, None], 1), (502, [math.nan] * 6, 1), (503, [math.inf] * 6, 1), (504, rows[3][1], None),
             (510, [2.0 * spread], 2), (511, [], 1), (600, [0.0] * 6, 1)]
    marked = negatives.labelled_vectors(vectors_frame(spark, rows), "vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 4 ELSE label END"), 256)
    got = negatives.hard_negatives(marked, F.col("key") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, 20, 7, 4, 256)


def test_hard_negatives_of_nothing(spark):
    marked = negatives.labelled_vectors(vectors_frame(spark, []), "vec_id", "embedding", F.col("label"), 256)
    assert negatives.hard_negatives(marked, F.col("key") % 2 == 0).collect() == []


@pytest.mark.parametrize("largest", [1, 200, 1 << 24, 1 << 40])
def test_packed_products_are_exact(largest):
    r = np.random.default_rng(1)
    rows, anchors = r.integers(-largest, largest + 1, (101, 7)), r.integers(-largest // 9 - 1, 2, (13, 7))
    packed = negatives.Packed(rows)
    want = [[sum(int(x) * int(y) for x, y in zip(a, c)) for c in rows] for a in anchors]
    if largest < 1 << 40:
        assert packed.products(anchors).tolist() == want
    else:
        with pytest.raises(OverflowError):
            packed.products(anchors * (1 << 20))
    assert largest > 200 or packed.fields > 1


# ---------------------------------------------------------------- repeated strings

def without_repeats(rows, length):
    """What remains of each row, looking at every string."""
    seen, out = set(), []
    for key, text in rows:
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone.update(range(i, i + length))
            seen.add(data[i : i + length])
        runs = [i for i in sorted(gone) if i - 1 not in gone]
        out.append((key, len(data), bytes(b for i, b in enumerate(data) if i not in gone), len(runs)))
    return out


def repeated_texts():
    pick = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgklmnprstv" for b in ("a", "e", "ié", "ou", "东")]

    def prose(n):
        return " ".join(pick.choice(words) + pick.choice(words) for _ in range(n))

    passage, base = prose(60), prose(300)
    near = base.split()
    near[150] = "changed"
    rows = [(i, prose(pick.randrange(5, 80)) + (f" {passage} " if i % 3 == 0 else " ") + prose(10)) for i in range(0, 120)]
    rows += [(200 + i, base) for i in range(40)] + [(300, " ".join(near)), (301, base[:700] + base[300:]), (302, "x" * 5000), (303, "ab" * 900 + "x" * 300),
             (304, None), (305, ""), (306, "y" * 99), (307, "y" * 99), (308, "z" * 100), (309, "z" * 100), (310, passage[:120]), (311, passage[40:160] + passage[40:160]),
             (312, " ".join(prose(4000) for _ in range(4)) + base), (None, base[100:400]), (None, base[100:400])]
    return rows


@pytest.mark.parametrize("length, chunk, step", [(100, suffixes.CHUNK, suffixes.STEP), (48, 7, 1000), (150, 1, 5000)])
def test_repeats_equal_a_search_of_all_strings(spark, monkeypatch, length, chunk, step):
    """Copies, a passage in a third of all texts, runs of one sign, strings over the edges of chunks and slices."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "STEP", step)
    rows = repeated_texts()
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x", 2, b"") for r in rows], "doc_id bigint, text string, start int, digest string, place int, kept binary").repartition(6)
    got = suffixes.remove_repeats(frame, length=length).collect()
    want = without_repeats(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), length)

    def plain(r):
        return str(r[0]), *r[1:]

    assert sorted(plain((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["removed"]))) for r in got) == sorted(map(plain, want))


def test_repeats_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id string, text string")
    assert suffixes.remove_repeats(frame).collect() == []
    with pytest.raises(ValueError):
        suffixes.remove_repeats(frame, length=20)


def test_multikey_quicksort_sorts():
    pick = np.random.default_rng(4)
    data = pick.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1300] = data[200:500]
    starts = pick.permutation(2800)
    order, same = suffixes.refine(suffixes._words(data, ">u8").astype(np.uint64), starts, 100)
    strings = [bytes(data[s : s + 100]) for s in starts[order]]
    assert strings == sorted(strings)
    assert same.tolist() == [False, *(a == b for a, b in zip(strings, strings[1:]))]
    assert all(x < y for x, y, s in zip(order, order[1:], same[1:]) if s)  # equal ones stay in the order given


# ---------------------------------------------------------------- token files

def test_rows_of_one_key_are_written_by_many_tasks(spark, tmp_path):
    """A key with most rows: no task writes more than its part, and the order by key holds."""
    pick = random.Random(5)
    rows = [(7 if i % 11 else i, " ".join(pick.choice(["one", "two", "three", "four"]) for _ in range(pick.randrange(3, 30)))) for i in range(3300)]
    rows += [(None, "lost words"), (None, None)]
    path = f"{tmp_path}/files"
    tokenizer = queries.vocabulary("word_bpe_49k.json")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), path, tokenizer)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    parts = [r["n"] for r in spark.read.parquet(f"{path}/parts").collect()]
    assert len(parts) > 4 and max(parts) < 0.3 * sum(parts)
    got = tokenfile.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    encode = Tokenizer.from_file(tokenizer).encode
    assert sorted(bytes(r["ids"]) for r in got) == sorted(np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)


def test_memory_of_words_is_bounded(monkeypatch):
    """With hardly any memory the ids stay right, and what is remembered stays within it."""
    path = queries.vocabulary("word_bpe_49k.json")
    words, whole = tokenfile.WordIds(open(path, encoding="utf-8").read(), "<u2"), Tokenizer.from_file(path)
    monkeypatch.setattr(tokenfile, "MEMORY", 60_000)
    pick = random.Random(9)
    for _ in range(6):
        texts = [" ".join(pick.choice("abcdefgéß") * pick.randrange(1, 9) + pick.choice(["", ".", "!?", "'s", "<|", "|", "東"]) for _ in range(200)) for _ in range(5)]
        texts += ["", " ", "Aµª º2 x². ÀÉ|", "a\tb\r\nc  d "]
        assert [np.frombuffer(b, "<u2").tolist() for b in words.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert words.size <= 60_000 and words.size == sum(len(w) + len(b) + tokenfile.ENTRY for w, b in words.known.items())


# ---------------------------------------------------------------- filters and recall

def test_filter_lacks_no_value(spark):
    values = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    pages, bits = bitmap(values, "hash", 3000)
    found = with_passed(spark.range(0, 60000).withColumn("page", F.lit(1)), F.xxhash64("id"), pages, bits, "passed")
    assert found.columns == ["id", "page", "passed"]
    passed = {r["id"] for r in found.where("passed").collect()}
    assert passed >= set(range(3000)) and len(passed) < 3000 + 0.05 * 57000
    nothing, bits = bitmap(values.where("false"), "hash", 0)
    assert with_passed(spark.range(10), F.xxhash64("id"), nothing, bits, "passed").where("passed").count() == 0


def test_recall_of_pairs_at_the_pipelines_limit(spark):
    """Pairs of texts between 80 and 82 percent alike, measured on full sets, are found at the pipeline's limit."""
    pick, rows, close = random.Random(21), [], 0
    for pair in range(1500):
        words = [f"{pair}w{i}" for i in range(pick.randrange(40, 160))]
        other = list(words)
        at = pick.randrange(5, len(other) - 5)
        cut = max(1, round(len(words) * 0.105))
        other[at : at + max(1, cut - 4)] = [f"{pair}x{i}" for i in range(max(1, cut - 4))]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other)]
        same, union = len(sets[0] & sets[1]), len(sets[0] | sets[1])
        if 80 * union <= 100 * same <= 82 * union:
            close += 1
            rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    groups, _ = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=80)
    found = groups.where("component_id <> key").count()
    print("pairs", close, "found", found)
    assert close > 200 and found >= 0.99 * close


# ---------------------------------------------------------------- secrets, disguises, memories

def test_keys_in_other_forms():
    """Legacy encrypted blocks with headers, keys over line ends without armour or in the URL alphabet; public keys are told apart."""
    key = rsa_key()
    coded = base64.b64encode(key).decode()
    lines = "\n".join(re.findall(".{1,64}", coded))
    url = base64.urlsafe_b64encode(key).rstrip(b"=").decode()
    assert "-" in url or "_" in url
    sealed = "\n".join(re.findall(".{1,64}", base64.b64encode(bytes(range(256)) * 2).decode()))
    block = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n" + sealed + "\n-----END RSA PRIVATE KEY-----"
    unsealed = block.replace("DEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n", "")
    for text, kind in ((f"x {lines} y", "der"), (f"x {url} y", "der"), (f"x {block} y", "pem")):
        spans, public = secrets.confirmed_spans(text)
        assert spans == [(2, len(text) - 2, kind)] and public == 0, kind
    assert secrets.confirmed_spans(unsealed)[0] == []

    def element(tag, data):
        size = len(data).to_bytes(2, "big").lstrip(b"\0") or b"\0"
        return bytes([tag]) + (bytes([len(data)]) if len(data) < 128 else bytes([0x80 | len(size)]) + size) + data

    spki = element(0x30, element(0x30, element(0x06, bytes([42, 134, 72]))) + element(0x03, b"\0" + bytes(range(1, 60))))
    text = f"-----BEGIN PUBLIC KEY-----\n{base64.b64encode(spki).decode()}\n-----END PUBLIC KEY-----"
    assert secrets.confirmed_spans(text) == ([(0, len(text), "pem")], 1)


@pytest.mark.parametrize("text, plain", [("1diot", "idiot"), ("a $tupid b", "stupid"), ("@ss", "ass"), ("a$$", "ass"), ('"id1ot"', "idiot"), ("(1d1ot)", "idiot"),
                                         ("i.d.i.o.t", "idiot"), ("st-u-pid!", "stupid"), ("no wonder. Next, it's fine!", None)])
def test_disguises(text, plain):
    found = [re.sub(r"[*.\-_]", "", d.lower().translate(toxicity.PLAIN)) for d in toxicity.disguises(text)]
    assert found == ([plain] if plain else [])


def test_pairs_of_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(transducer, "MOST_PAIRS", 50)
    pick = random.Random(1)
    letters = [bytes([b]) for b in range(97, 101)]
    machine = transducer.CountingMachine({w: i for i, w in enumerate([*letters, b"ab", b"cd", b"abcd", b"bc"])}, {(b"a", b"b"): 0, (b"c", b"d"): 1, (b"ab", b"cd"): 2, (b"b", b"c"): 3})
    for _ in range(300):
        word = "".join(pick.choice("abcd") for _ in range(pick.randrange(1, 30)))
        assert machine.count(word) == len(machine.merged(word.encode()))
        assert len(machine.allowed) < 50 + 30 * 8


# ---------------------------------------------------------------- classifiers, one number at a time

def slow_score(net, text):
    """The byte network with loops over bytes, windows, chunks and filters."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    data = list(text.encode())
    while len(data) < bytecnn.WIDTH or (len(data) - bytecnn.WIDTH) % bytecnn.STRIDE:
        data.append(0)
    responses = []
    for at in range(0, len(data) - bytecnn.WIDTH + 1, bytecnn.STRIDE):
        seen = [x for b in data[at : at + bytecnn.WIDTH] for x in w["embed"][b]]
        responses.append([sum(x * f for x, f in zip(seen, w["filters"][:, j])) for j in range(bytecnn.FILTERS)])
    chunks, first = [], 0
    while True:
        part = responses[first : first + bytecnn.CHUNK]
        chunks.append([max(0.0, max(r[j] for r in part) + w["shift"][0, j]) for j in range(bytecnn.FILTERS)])
        if first + bytecnn.CHUNK >= len(responses):
            break
        first += bytecnn.HOP
    pooled = [f(c[j] for c in chunks) for f in (lambda v: sum(v) / len(chunks), max, min) for j in range(bytecnn.FILTERS)]
    hidden = [max(0.0, sum(x * h for x, h in zip(pooled, w["hidden"][:, i])) + w["bias"][0, i]) for i in range(bytecnn.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(h * o for h, o in zip(hidden, w["out"][:, 0])) + w["prior"][0, 0])))


def test_network_equals_its_loops():
    net, pick = bytecnn.ByteNet(4), random.Random(8)
    net.weights["shift"][:] = np.linspace(-0.5, 0.5, bytecnn.FILTERS, dtype=np.float32)
    texts = ["", "a", "é" * 4, "12345678", "123456789", "x" * 500] + ["".join(pick.choice("abc dé.!\n") for _ in range(n)) for n in (7, 9, 128, 131, 132, 133, 700)]
    assert np.allclose(net.score(texts), [slow_score(net, t) for t in texts], atol=1e-5)


def slow_tree(rows, g, h, ridge, depth, level=0):
    """The best split by trying every feature and every value between two different ones."""
    total_g, total_h = sum(g), sum(h)
    if level == depth:
        return total_g / (total_h + ridge)
    best = (1e-6, None, None)
    for f in range(len(rows[0]) if len(rows) >= 2 else 0):
        for limit in sorted({r[f] for r in rows}):
            left = [i for i, r in enumerate(rows) if r[f] <= limit]
            a, b = sum(g[i] for i in left), sum(h[i] for i in left)
            gain = a**2 / (b + ridge) + (total_g - a) ** 2 / (total_h - b + ridge) - total_g**2 / (total_h + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, f, limit)
    _, f, limit = best
    sides = [[i for i, r in enumerate(rows) if f is None or r[f] <= limit], [i for i, r in enumerate(rows) if f is not None and r[f] > limit]]
    return f, limit, [slow_tree([rows[i] for i in s], [g[i] for i in s], [h[i] for i in s], ridge, depth, level + 1) if s else None for s in sides]


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2][0 if tree[0] is None or row[tree[0]] <= tree[1] else 1]
    return tree or 0.0


def test_boosted_trees_equal_trying_every_split():
    """Few different values, so the bins hold each of them: splits, leaves and margins of both ways agree."""
    draw = np.random.default_rng(6)
    x = draw.integers(0, 6, (160, 3)).astype(float) + np.array([0, 0.25, 0.5])
    y = (x[:, 0] + 2 * (x[:, 1] > 3) + draw.normal(size=160) > 4).astype(float)
    made = toxicity.Trees(x, y, rounds=5, bins=400)
    rows, margin = x.tolist(), [made.start] * len(y)
    assert made.start == pytest.approx(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(5):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tree = slow_tree(rows, [v - q for v, q in zip(y, p)], [q * (1 - q) for q in p], 1.0, 3)
        margin = [m + made.rate * walked(tree, r) for m, r in zip(margin, rows)]
    assert np.allclose(made.margin(x), margin)


def test_calibration_equals_the_min_max_formula():
    """The rising fit at a point is the largest mean from some start to it, of the least means to some end behind it."""
    draw = np.random.default_rng(12)
    margin = np.round(draw.normal(size=60), 1)
    y = (draw.random(60) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    levels = sorted(set(margin.tolist()))
    sums = [(y[margin == v].sum(), (margin == v).sum()) for v in levels]
    (at, value), want = toxicity.isotonic(margin, y), 0.0
    for k, level in enumerate(levels):
        a, b = max(((i, min(range(k, len(levels)), key=lambda j: (sum(s for s, _ in sums[i : j + 1]) / sum(c for _, c in sums[i : j + 1]), -j))) for i in range(k + 1)),
                   key=lambda e: (round(sum(s for s, _ in sums[e[0] : e[1] + 1]) / sum(c for _, c in sums[e[0] : e[1] + 1]), 12), -e[0]))
        s, c = sum(s for s, _ in sums[a : b + 1]), sum(c for _, c in sums[a : b + 1])
        want = max(want, (s + y.mean()) / (c + 1))
        assert float(np.interp(level, at, value)) == pytest.approx(want)


def slow_features(text, lexicon):
    """Every feature by its definition, word by word."""
    words = re.findall(r"\w+", text.lower())
    n = max(1, len(words))
    whole = [lexicon.get(w, 0.0) for w in words]
    begun = [max((lexicon.get(w[:k] + "*", 0.0) for k in toxicity.STARTS if len(w) > k), default=0.0) for w in words]
    hidden = [re.sub(r"[*.\-_]", "", d.lower().translate(toxicity.PLAIN)) for d in toxicity.disguises(text)]
    near = sum(1 for i in range(len(words)) if (whole[i] or begun[i]) and any(words[j] in toxicity.YOU for j in range(max(0, i - 5), min(len(words), i + 6))))
    marks = re.findall(r"!!+|\?\?+|\.\.+|##+|\*\*+|&&+|\$\$+|%%+", text)
    shouted = [w for w in re.findall(r"\w+", text) if len(w) >= 3 and all(c.isupper() for c in w)]
    chars = max(1, len(text))
    return {"words": math.log1p(len(words)), "hit_count": sum(x != 0 for x in whole), "hit_share": sum(x != 0 for x in whole) / n, "weight_share": sum(whole) / n,
            "most": max([0.0, *whole, *begun]), "start_count": sum(x != 0 for x in begun), "start_share": sum(x != 0 for x in begun) / n,
            "disguised_hits": sum(1 for d in hidden if lexicon.get(d) or any(lexicon.get(d[:k] + "*") for k in toxicity.STARTS if len(d) > k)), "disguised_share": len(hidden) / n,
            "you_share": sum(w in toxicity.YOU for w in words) / n, "you_near": near / n, "capitals": sum(c.isupper() for c in text) / chars, "shouted": len(shouted) / n,
            "exclaims": text.count("!") / n, "questions": text.count("?") / n, "signs": sum(c in "#&*$%@!?" for c in text) / chars, "doubled": len(marks) / n}


@pytest.mark.parametrize("text", ["", "You are an 1diot!!", "IDIOTS everywhere?? you, YOU stupidly $tupid", "nothing to see here. Really... ok", "Der i.d.i.o.t sagte: du bist DUMM &&& #1",
                                  "word " * 40 + "idiot " + "filler " * 4 + "you " + "rest " * 9])
def test_features_equal_their_definitions(text):
    lexicon = {"idiot": 2.0, "idio*": 1.5, "stupi*": 1.0, "dumm": 0.7, "stupid": 1.2}
    assert dict(zip(toxicity.FEATURES, toxicity.Features(lexicon).of(text))) == pytest.approx(slow_features(text, lexicon))
