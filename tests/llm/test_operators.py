"""Each operator against a plain version on awkward rows, on an empty table, and with clashing column names."""

import base64
import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from inkgauge.llm import byte_bpe, chat, exact_dedup, fingerprints, language_id, licences, line_dedup, near_dedup, packing, sharding
from inkgauge.llm.licence_texts import LICENCES

from .conftest import awkward_rows

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# --- exact dedup -------------------------------------------------------------------------------------------------------


def test_merge_of_sorted_runs():
    """Blocks of several runs, read by their lowest keys, make one run; equal keys are folded to the smallest identifier."""
    rng = np.random.default_rng(0)
    batches, want = [], {}
    for run in range(5):
        entries = np.zeros(300, exact_dedup._ENTRY)
        entries["key"] = [b"%03d" % k for k in np.sort(rng.integers(0, 400, 300))]
        entries["id"], entries["row"], entries["n"] = rng.integers(0, 50, 300), run * 1000 + np.arange(300), 1
        entries["none"] = rng.random(300) < 0.2
        for e in entries:
            best, n = want.get(e["key"], ((9, 0, 0), 0))
            want[e["key"]] = min(best, (int(e["none"]), int(e["id"]), int(e["row"]))), n + 1
        out = exact_dedup._Writer(0, 0)
        for k in range(0, 300, 70):
            batches += out.add(entries[k : k + 70])
        batches += out.close()
    small = []
    for b in batches:  # cut into small blocks
        whole = np.frombuffer(b["entries"][0].as_py(), exact_dedup._ENTRY)
        small += [(p["key"][0].ljust(44, b"\0"), p.tobytes()) for p in np.split(whole, range(40, len(whole), 40)) if len(p)]
    pa = exact_dedup.pa
    blocks = [pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([low]), pa.array([x])], ["slice", "run", "low", "entries"]) for low, x in sorted(small)]
    merged = np.concatenate([np.frombuffer(b["entries"][0].as_py(), exact_dedup._ENTRY) for b in exact_dedup._merge_runs(iter(blocks))])
    assert merged["key"].tolist() == sorted(want)
    assert {e["key"]: ((int(e["none"]), int(e["id"]), int(e["row"])), int(e["n"])) for e in merged} == want


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup_equals_grouping(docs, fan_in):
    found = rows(exact_dedup.exact_dedup(docs, fan_in=fan_in))
    groups = defaultdict(list)
    for doc, text, *_ in awkward_rows():
        groups[norm(text)].append(doc)
    assert len(found) == len(awkward_rows())
    for text, ids in groups.items():
        got = [r for r in found if r["text_sha256"] == sha(text)]
        assert Counter(r["doc_id"] for r in got) == Counter(ids)
        assert {r["keep_id"] for r in got} == {min((i for i in ids if i is not None), default=None)}
        assert {r["group_size"] for r in got} == {len(ids)}
        assert sum(r["kept"] for r in got) == 1


def test_exact_dedup_of_hot_group(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', concat('t', id)) AS text").repartition(23)
    found = exact_dedup.exact_dedup(df, fan_in=4)
    assert found.filter("kept").count() == 6001
    assert found.filter("group_size = 3000 AND keep_id = 0").count() == 3000


# --- sharding ----------------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_and_balanced(docs):
    found = rows(sharding.shard_by_bytes(docs, shards=4))
    texts = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in awkward_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    for shard in range(4):
        part = [r for r in order if r["shard"] == shard]
        assert [r["slot"] for r in part] == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 4) <= largest
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_shards_equal_plain_cuts(spark):
    """A row lies in the shard that holds the middle of its bytes, in the order of ids."""
    rng = np.random.default_rng(4)
    texts = {int(d): "é" * int(n) for d, n in zip(rng.permutation(3000)[:700], rng.integers(0, 40, 700))}
    found = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)).collect()}
    total, begin, slots = sum(2 * len(t) + 1 for t in texts.values()), 0, Counter()
    for doc in sorted(texts):
        size = 2 * len(texts[doc]) + 1
        shard = min(15, (2 * begin + size) * 16 // (2 * total))
        assert found[doc] == (shard, slots[shard])
        slots[shard] += 1
        begin += size


def test_shards_of_many_rows_are_near_equal(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(id % 17 as int)) AS text").repartition(7)
    sizes = [r["b"] for r in sharding.shard_by_bytes(df, shards=16).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 17


# --- packing -----------------------------------------------------------------------------------------------------------


def test_packing_equals_tokenizer(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    found = packing.pack(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), tokenizer_path=WORDS, max_tokens=64, with_ids=True)
    found = rows(found)
    assert len({r["sequence_id"] for r in found}) == len(found)
    by_doc = defaultdict(list)
    for r in found:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and r["bucket"] == r["length"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append(r)
    for doc, text, *_ in awkward_rows():
        if doc is None:
            continue
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == want
        assert all(r["doc_tokens"] == len(want) for r in pieces)
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()


def test_word_table_equals_tokenizer_on_odd_texts():
    tokenizer = Tokenizer.from_file(WORDS)
    odd = ["", "  ", "a\n\nB", "\x01 a \x01b\x01", "ΑΣ ΑΣ. İ", "don't we'll", "<|endoftext|>x", "é ́", "x\x1cy\x85z w", "日本語🙂"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert list(packing.encode(odd, WORDS, bound=3)) == want
    tokenizer.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert list(packing.encode(odd, WORDS, bound=3, plain_specials=True)) == want


def test_binary_lengths():
    assert packing.binary_lengths(4096 * 2 + 13, 4096) == [4096, 4096, 8, 4, 1]
    assert packing.binary_lengths(0, 4096) == []


# --- byte-level BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(docs, reference_encoding):
    found = rows(byte_bpe.encode_documents(docs, ranks_path=RANKS, pattern=public_tokenizers.PATTERN, with_ids=True))
    want = Counter()
    for doc, text, *_ in awkward_rows():
        ids = reference_encoding.encode_ordinary(text or "")
        want[doc, len(ids), sha(",".join(map(str, ids))), sha(text or "")] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want


def test_bpe_on_random_texts(reference_encoding):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n'st.é́Σ1\t<| \x1c") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    own = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, 100)
    for text, (raw, decimal) in zip(texts, own.encode(texts)):
        want = reference_encoding.encode_ordinary(text)
        assert np.frombuffer(raw, "<u4").tolist() == want
        assert decimal.decode() == ",".join(map(str, want))
        assert own.decode(raw) == text.encode()


def test_replay_takes_lower_rank_first():
    """A merge that makes a pair of lower rank: ABA is ranked before AB, so only the first AB of ABAB stands."""
    merges = byte_bpe.Merges.__new__(byte_bpe.Merges)
    merges.rank = {bytes([b]): b + 1000 for b in range(256)} | {b"ba": 1, b"aba": 2, b"ab": 0}
    merges.token = {r: t for t, r in merges.rank.items()}
    pairs = {}
    for token, r in merges.rank.items():
        for cut in range(1, len(token)):
            pairs[merges.rank[token[:cut]] << 32 | merges.rank[token[cut:]]] = r
    merges.keys = np.array(sorted(pairs), np.int64)
    merges.ranks = np.array([pairs[k] for k in merges.keys.tolist()], np.int64)
    merges.byte = np.array([merges.rank[bytes([b])] for b in range(256)], np.int64)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            ranked = [(merges.rank.get(a + b, 9999), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == 9999:
                return [merges.rank[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [b"abab", b"ababab", b"bababa", b"aab", b"", b"abba", b"aabbaab"]
    ids, starts = merges.replay(words)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [plain(w) for w in words]


# --- language ID -------------------------------------------------------------------------------------------------------


def test_language_id_accuracy_and_und(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    found = language_id.identify(df).collect()
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_cases(docs, empty):
    found = language_id.identify(docs, dims=256).collect()
    assert len(found) == len(awkward_rows())
    und = {5, 6, 7, 11}
    assert all((r.lang_pred == "und") == (r.doc_id in und) for r in found if r.doc_id is not None)
    assert not [r for r in found if r.doc_id is None and r.held_out]
    nothing = language_id.identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).replace("", None, ["lang"])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_id_bounded_sample(docs):
    assert language_id.identify(docs, dims=128, max_training_rows=5).count() == len(awkward_rows())


def test_language_id_learns_rare_labels(spark):
    """Of many rows a small sample is learnt from, and labels with a row or two are among it; ids may be null."""
    rare = [f"{chr(0x400 + 40 + 3 * k)}{chr(0x400 + 41 + 3 * k)} " * 20 for k in range(8)]
    table = [(None, text, f"r{k}") for k, text in enumerate(rare)] + [(None, "12 34", "r0")]
    table += [(k if k % 2 else None, f"common words number {'abcdefgh'[k % 8]} of many", "en") for k in range(2000)]
    df = spark.createDataFrame(table, "doc_id bigint, text string, lang string").repartition(3)
    found = {(r.text, r.lang_pred) for r in language_id.identify(df, dims=256, max_training_rows=60, keep_columns=True).filter("lang <> 'en'").collect()}
    assert found == {(text, f"r{k}") for k, text in enumerate(rare)} | {("12 34", "und")}
    assert language_id.rows_a_label([1, 5, 100, 200], 106) == 50 and language_id.rows_a_label([3, 3], 1) == 1
    assert language_id.rows_a_label([4, 9], 20) == 9 and language_id.rows_a_label([], 5) == 1


def test_language_id_equals_plain_hypervectors(spark):
    """Letter vectors rotated, multiplied and summed in plain loops."""
    dims = 64

    def letter(c):
        return np.random.default_rng(ord(c)).integers(0, 2, dims).astype(np.int64) * 2 - 1

    def vector(text):
        symbols = [" "]
        for c in text.lower() + " ":
            if c.isalpha():
                symbols.append(c)
            elif symbols[-1] != " ":
                symbols.append(" ")
        out = np.zeros(dims, np.int64)
        for x, y, z in zip(symbols, symbols[1:], symbols[2:]):
            out += np.roll(letter(x), 2) * np.roll(letter(y), 1) * letter(z)
        return out

    rows = [(1, "the cat sat on the mat", "en"), (2, "den Hund im Garten, ja!", "de"), (3, "le chat est là", "fr"), (4, "the dog", "en"), (9, "der Hund", None)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2] + [(100 + k, f"la maison {k} bleue", "fr") for k in range(6)]
    learnt = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    prototypes = {x: sum(vector(t) for _, t, y in learnt if x == y) for x in sorted({r[2] for r in learnt})}
    for r in language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), dims=dims, keep_columns=True).collect():
        v = vector(r.text)
        cosine = {x: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for x, p in prototypes.items()}
        assert abs(r.score - max(0.0, max(cosine.values()))) < 1e-5 and cosine[r.lang_pred] >= max(cosine.values()) - 1e-6


def test_language_id_refuses_too_many_labels(docs, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LABELS", 1)
    with pytest.raises(ValueError, match="different values"):
        language_id.identify(docs)


# --- near-dedup --------------------------------------------------------------------------------------------------------


def plain_components(texts, size, percent):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[max(find(i), find(j))] = min(find(i), find(j))
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("size", [4, 5])
def test_near_dedup_equals_brute_force(docs, size):
    found = rows(near_dedup.near_components(docs, words=size))
    data = awkward_rows()
    counts, roots = plain_components([t for _, t, *_ in data], size, 80)
    want = Counter()
    for (doc, *_), n, root in zip(data, counts, roots):
        ids = [data[i][0] for i, r in enumerate(roots) if r == root and data[i][0] is not None]
        top = min(ids, default=None)
        want[doc, n, top, doc == top] += 1
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == want
    assert sum(r["first"] for r in found) == len(set(roots))


def test_near_dedup_joins_chains_and_open_buckets(spark):
    """Chains of copies, each near its neighbours only, and a hub whose variants are not near each other."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(12):
        w = list(base)
        w[: 8 * k] = [f"x{i}" for i in range(8 * k)]
        texts.append(" ".join(w))
    for k in range(30):
        w = [f"h{i}" for i in range(160)]
        for j in range(3):
            w[(k * 5 + j * 50) % 160] = f"v{k}-{j}"
        texts.append(" ".join(w))
    texts.append(" ".join(f"h{i}" for i in range(160)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    _, roots = plain_components(texts, 4, 80)
    found = {r.doc_id: r.component_id for r in near_dedup.near_components(df, words=4).collect()}
    assert [found[i] for i in range(len(texts))] == roots


@pytest.mark.parametrize("block", [3])
def test_near_dedup_of_large_open_buckets(spark, monkeypatch, block):
    """Many texts that share half of their words with one another, in clusters: buckets are cut, blocked, and no link is lost."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SET_BYTES", 4_000)
    rng, texts = random.Random(1), []
    shared = [f"s{i}" for i in range(150)]
    for cluster in range(12):
        own = shared + [f"c{cluster}-{i}" for i in range(70)]
        for _ in range(5):
            w = list(own)
            w[rng.randrange(150, 220)] = f"x{rng.random()}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    _, roots = plain_components(texts, 4, 80)
    found = {r.doc_id: r.component_id for r in near_dedup.near_components(df, words=4).collect()}
    assert [found[i] for i in range(len(texts))] == roots


def test_near_dedup_without_pruning(docs):
    assert near_dedup.least_matches(0.8, 0) == [(m, 0) for m in range(near_dedup.STEP, near_dedup.HASHES + 1, near_dedup.STEP)]


def test_components_of_a_hub_and_a_chain(spark):
    from inkgauge.llm.common import Workspace
    from inkgauge.llm.components import components

    links = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5060)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Workspace(spark), "c").collect()}
    assert found == {k: 0 for k in range(1, 3000)} | {k: 5000 for k in range(5001, 5061)}


def test_near_dedup_keeps_one_row_of_each(docs):
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    _, roots = plain_components([t for _, t, *_ in awkward_rows()], 5, 80)
    assert kept.count() == len(set(roots))


def test_least_matches_bounds_the_miss():
    for m, x in near_dedup.least_matches(0.8, 1e-6):
        tail = lambda k, m=m: sum(near_dedup.math.comb(m + 1, i) * 0.8**i * 0.2 ** (m + 1 - i) for i in range(k + 1))
        assert tail(x) >= 1e-6 > tail(x - 1)


# --- line dedup --------------------------------------------------------------------------------------------------------


def plain_line_dedup(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    first, gone = {}, [set() for _ in lines]
    for a, own in enumerate(lines):
        for i in range(len(own)):
            words = 0
            for j in range(i, len(own)):
                words += len(re.findall(r"[^\x20\x09-\x0D]+", own[j]))
                if words >= least:
                    b, p = first.setdefault("\n".join(own[i : j + 1]), (a, i))
                    if (b, p) != (a, i) and (b != a or i >= p + j - i + 1):
                        gone[a].update(range(i, j + 1))
    return [("\n".join(x for k, x in enumerate(own) if k not in g), len(g)) for own, g in zip(lines, gone)]


@pytest.mark.parametrize("least", [1, 4, 7])
def test_line_dedup_equals_brute_force(spark, least):
    import random

    rng = random.Random(least)
    texts = ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3]))) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts += [texts[3], texts[4] + "\n" + texts[5], "", "q q q q\n" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(df, min_words=least).collect()}
    want = plain_line_dedup(texts, least)
    assert [found[i] for i in range(len(texts))] == want


def test_line_dedup_cases(docs):
    found = rows(line_dedup.line_dedup(docs, min_words=50))
    assert len(found) == len(awkward_rows())
    null = [r for r in found if r["doc_id"] in (5, None) and r["text"] is None]
    assert null and all(r["n_lines"] == 0 and r["n_removed"] == 0 for r in null)
    assert [r["text"] for r in found if r["doc_id"] == 1] == [awkward_rows()[0][1]]
    assert all(r["text"] == "" and r["n_removed"] == 1 for r in found if r["doc_id"] == 2)  # both rows come after 1


# --- fingerprints ------------------------------------------------------------------------------------------------------


def test_fingerprints_edit_and_neighbour(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").repartition(3)
    texts = {r.doc_id: r.text for r in df.collect()}
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    order = sorted(texts, reverse=True)
    assert found.keys() == texts.keys()
    for doc, after in zip(order, order[1:] + order[:1]):
        t, u, r = texts[doc], texts[after], found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - len(t) // 2] + u[: len(t) // 2]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = defaultdict(set)
    for doc, r in found.items():
        same[texts[doc]].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len({r.fingerprint for r in found.values()}) == len(same)
    long = [r for r in found.values() if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_fingerprint_sums():
    a, b, ab, ba = fingerprints.fingerprints(["one\ntwo", "three", "one\ntwo\nthree", "three\ntwo\none"])[:, None]
    assert fingerprints.combine(a, b).tobytes() == ab.tobytes() == ba.tobytes()
    assert fingerprints.combine(ab, b, -1).tobytes() == a.tobytes()
    assert fingerprints.likeness(ab, ba)[0] == 1 > fingerprints.likeness(a, ab)[0] > 0


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_likeness_of_long_texts(n):
    """Texts with nothing in common and texts that share half, of so many paragraphs each; the estimates' means over pairs."""
    pairs = 12
    text = lambda *ranges: "\n".join(f"p{k}" for a, b in ranges for k in range(a, b))
    apart, half = [], []
    for k in range(pairs):
        a = 10 * n * k
        one, other, mixed = fingerprints.fingerprints([text((a, a + n)), text((a + n, a + 2 * n)), text((a, a + n // 2), (a + 2 * n, a + 2 * n + n // 2))])[:, None]
        apart.append(fingerprints.likeness(one, other)[0])
        half.append(fingerprints.likeness(one, mixed)[0])
    assert np.mean(apart) < 0.25
    assert 0.3 < np.mean(half) < 0.7


def test_finest_level_is_not_crowded():
    assert fingerprints.LANES * 2.0 ** (fingerprints.LEVELS - 1) >= 2**31


def test_fingerprints_cases(docs):
    found = rows(fingerprints.edited_fingerprints(docs))
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, *_ in awkward_rows())
    assert Counter(r["n_chars"] for r in found) == Counter(len(t or "") for _, t, *_ in awkward_rows())


def plain_fingerprint(text):
    """Counts and sums by plain loops over the paragraphs."""
    import xxhash

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    units = [p for line in text.split("\n") for p in line.replace(". ", ".\n").split("\n") if p]
    wide, fine = [0] * fingerprints.WIDE, [[0] * fingerprints.LANES for _ in range(fingerprints.LEVELS)]
    for unit in units:
        h = xxhash.xxh3_64_intdigest(unit)
        for k in range(fingerprints.WIDE):
            wide[k] = (wide[k] + mix((h + (k + 1) * 0x9E3779B97F4A7C15) % 2**64)) % 2**64
        place = mix(h ^ 0xD1B54A32D192ED03)
        for level in range(fingerprints.LEVELS):
            if place >> 8 & 0xFFFFFFFF < 2**32 >> level:
                lane = place % fingerprints.LANES
                fine[level][lane] = (fine[level][lane] + (place >> 48)) % 2**16
    return len(units), wide, fine


def plain_likeness(a, b):
    if a[:2] == b[:2]:
        return 1.0
    differ = [sum(x != y for x, y in zip(p, q)) for p, q in zip(a[2], b[2])]
    level = next((k for k, d in enumerate(differ) if d <= 0.7 * fingerprints.LANES), fingerprints.LEVELS - 1)
    alone = -fingerprints.LANES * np.log1p(-min(differ[level], fingerprints.LANES - 0.5) / fingerprints.LANES) * 2.0**level
    return min(1.0, max(0.0, 1 - max(alone, 1.0) / max(a[0] + b[0], 1)))


def test_fingerprints_equal_plain_sums(docs):
    """Fingerprints, edited ones and both likenesses of every row against the plain version, in the order of the ids."""
    found = [r for r in fingerprints.edited_fingerprints(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()]
    texts = {d: t or "" for d, t, *_ in awkward_rows() if d is not None}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        text, follows = texts[r.doc_id], texts[after[r.doc_id]]
        half = len(text) // 2
        own, edited, beside = map(plain_fingerprint, (text, text[: len(text) - half] + follows[:half], follows))
        for shown, plain in ((r.fingerprint, own), (r.edited_fingerprint, edited)):
            record = np.frombuffer(bytes.fromhex(shown), fingerprints._RECORD)[0]
            assert (int(record["count"]), record["wide"].tolist(), record["fine"].tolist()) == plain
        assert abs(r.near_edited - plain_likeness(own, edited)) < 1e-9 and abs(r.near_next - plain_likeness(own, beside)) < 1e-9


@pytest.mark.parametrize("text", ["concat('text ', id)", "'same'"])
def test_fingerprints_of_a_hot_id(spark, text):
    """Rows of one id, of different texts or equal ones, are spread over partitions; each has its neighbour."""
    df = spark.range(6000).selectExpr("if(id < 5000, 7L, id) AS doc_id", f"if(id < 5000, {text}, concat('t', id)) AS text").repartition(5)
    done = fingerprints.edited_fingerprints(df)
    sizes = [r["count"] for r in done.filter("doc_id = 7").groupBy(fingerprints.F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 4000
    like = done.filter("doc_id = 7 AND near_next = 1").count()
    assert like == (4999 if text == "'same'" else 0) and done.count() == 6000


def test_fingerprint_of_single_row(spark):
    (r,) = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert r.edited_sha256 == sha("abab")


# --- licences ----------------------------------------------------------------------------------------------------------


def test_licences_in_other_dress(spark):
    mit = LICENCES["MIT"]
    texts = [
        mit,
        "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper(),
        re.sub(r"[,.\"]", " ", mit).replace(" ", "\n "),
        mit.replace("sublicense", "sub-licence"),
        mit + " And more.",
        "Released under the MIT License.",
        "released under the mit licence",
        None,
        "",
        "Copyright 2020 X",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.licence_id for r in licences.scan(df).collect()}
    assert [found[i] for i in range(10)] == ["MIT"] * 4 + [None] * 6
    names = sorted(LICENCES)
    swapped = spark.createDataFrame([(k, LICENCES[name].swapcase()) for k, name in enumerate(names)], "doc_id bigint, text string")
    assert {r.doc_id: r.licence_id for r in licences.scan(swapped).collect()} == dict(enumerate(names))


def test_licences_as_whole_files(spark):
    """LICENSE files with titles, holders without a year, any line width, and the long licences."""
    mit, bsd = LICENCES["MIT"], LICENCES["BSD-3-Clause"]
    want = [
        ("MIT License\n\nCopyright (c) 2020 X\n\n" + mit, "MIT"),
        ("(The MIT License)\n=====\nCopyright Joyent, Inc. and other Node contributors.\n" + mit, "MIT"),
        ("Copyright The Rust Project Developers\nCopyright: Somebody\n" + mit, "MIT"),
        ("BSD 3-Clause License\n\nCopyright (c) 2022, X\nAll rights reserved.\n\n" + re.sub(r"\n\d\.", "\n*", bsd), "BSD-3-Clause"),
        ("zlib License\n\n(C) 2020 X\n\n" + LICENCES["Zlib"], "Zlib"),
        ("ISC License\n\nCopyright X\n\n" + LICENCES["ISC"], "ISC"),
        (LICENCES["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Somebody"), "Apache-2.0"),
        (LICENCES["Apache-2.0"].split("   APPENDIX:")[0].replace("http:", "https:"), "Apache-2.0"),
        ("MIT License\nCopyright X\n" + mit + "\nAnd more.", None),
    ]
    long = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0", "Artistic-2.0"]
    want += [(LICENCES[name], name) for name in long]
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "BlueOak-1.0.0"):
        want += [("\n".join(textwrap.wrap(LICENCES[name], width, break_long_words=False, break_on_hyphens=False)), name) for width in range(14, 90, 5)]
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(want)], "doc_id bigint, text string")
    found = {r.doc_id: r.licence_id for r in licences.scan(df).collect()}
    assert [(k, found[k]) for k in range(len(want))] == [(k, name) for k, (_, name) in enumerate(want)]


def plain_canonical(text):
    """The canonical form, written line by line without the operator's patterns."""
    kept = []
    for line in (text or "").lower().split("\n"):
        bare = line.lstrip("".join(c for c in map(chr, range(128)) if not c.isalnum()) + "©")
        sign = line[: len(line) - len(bare)]
        words = bare.replace(":", " ").split()
        named = len(words) > 1 and words[0] == "copyright" and words[1].strip("(),.") not in licence_prose and words[1:3] != ["the", "software"]
        if "(c" in sign or "©" in sign or bare.startswith("spdx-") or named or bare.rstrip(" .!") == "all rights reserved":
            continue
        kept.append(line)
    out = "".join(c if c.isalnum() else " " for c in "\n".join(kept))
    out = " ".join(out.split()) + " "
    for one, other in licences.SPELLINGS.items():
        out = out.replace(one, other)
    return out.strip()


licence_prose = {"and", "holder", "holders", "notice", "license", "licence", "law", "in", "owner", "is"}


def test_licences_planted_among_documents(spark, data):
    """Whole licences in other dress planted among real documents: exactly these are found, as by a plain canonical form."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    dress = [
        lambda t: t,
        lambda t: "Copyright (c) 2021 Ada Example\n\n" + t.upper(),
        lambda t: "\n".join(textwrap.wrap(t, 60, break_long_words=False, break_on_hyphens=False)),
        lambda t: t.replace("license", "licence").replace(",", " ,"),
    ]
    planted = [(10**6 + 10 * k + j, f(LICENCES[name]), name) for k, name in enumerate(sorted(LICENCES)) for j, f in enumerate(dress)]
    planted = [p for p in planted if not (p[0] % 10 == 2 and p[2] in LONG_LINES)]
    near = [(2 * 10**6 + k, LICENCES[name] + "\nOne more clause.") for k, name in enumerate(sorted(LICENCES))]
    df = spark.createDataFrame([*docs, *[p[:2] for p in planted], *near], "doc_id bigint, text string")
    found = {r.doc_id: r.licence_id for r in licences.scan(df).collect()}
    assert {d: x for d, x in found.items() if x} == {d: name for d, _, name in planted}
    known = {plain_canonical(t): name for name, t in LICENCES.items() if name in ("MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "MIT-0")}
    want = {d: known[plain_canonical(t)] for d, t, name in planted if plain_canonical(t) in known}
    assert want and all(found[d] == name for d, name in want.items()) and len(want) >= 7 * 4


#: Their own line ends carry meaning for the pattern of copyright lines, so they are not wrapped anew here.
LONG_LINES = {name for name, text in LICENCES.items() if len(text) > 3000} | {"Unicode-3.0"}


def test_licences_large_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licences, "MAX_BROADCAST", 0)
    (r,) = licences.scan(spark.createDataFrame([(1, LICENCES["ISC"])], "doc_id bigint, text string")).collect()
    assert r.licence_id == "ISC"


# --- chat --------------------------------------------------------------------------------------------------------------

NODE = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def test_chat_picks_best_branches(spark):
    nodes = [
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "bad", 0.1),
        (1, 3, 1, "assistant", "good", 0.9),
        (1, 4, 3, "user", "thanks", 0.0),
        (1, 5, 2, "user", "hm", 0.0),
        (1, 5, 2, "user", "hm", 0.0),  # repeated
        (2, 1, 1, "user", None, None),  # its own parent: a root
        (2, 2, 99, None, "lost", 0.5),  # a missing parent: a root
        (None, 1, None, "user", "x", 0.0),
    ]
    df = spark.createDataFrame(nodes, NODE)
    found = rows(chat.format_trees(df, top=2).orderBy("tree", "rank"))
    assert [(r["tree"], r["leaf"], r["rank"], r["n_turns"]) for r in found] == [(None, 1, 1, 1), (1, 4, 1, 3), (1, 5, 2, 3), (2, 2, 1, 1), (2, 1, 2, 1)]
    assert found[1]["formatted"] == "<|turn|>user\nq<|end|>\n<|turn|>assistant\ngood<|end|>\n<|turn|>user\nthanks<|end|>\n"
    ((start, length),) = found[1]["loss_spans"]
    assert found[1]["formatted"][start : start + length] == "good"


def test_chat_round_trip(spark):
    hostile = ["", "\\", "\\\\l<|", "<|turn|>x\ny<|end|>\n", "</s>[INST] ok [/INST]", "\\n\\o\\l", "🙂 <|end|>", "\n", None]
    df = spark.createDataFrame([(0, k, "assistant" if k % 2 else "us\ner<|", t) for k, t in enumerate(hostile)], "conv_id bigint, turn bigint, role string, text string")
    (r,) = (
        chat.format_trees(chat.threads(df))
        .select(chat.read_back(chat.F.col("formatted")).alias("t"), chat.read_loss(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss"))
        .collect()
    )
    assert [(x.role, x.text) for x in r.t] == [("assistant" if k % 2 else "us\ner<|", t or "") for k, t in enumerate(hostile)]
    assert r.loss == "".join(t or "" for t in hostile[1::2])


def test_chat_long_thread(spark):
    df = spark.range(300).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    (r,) = chat.format_trees(chat.threads(df)).collect()
    assert r.n_turns == 300 and re.findall(r"\n(\d+)<", r.formatted) == [str(k) for k in range(300)]


def test_chat_saves_one_table_of_new_rows_a_round(spark, monkeypatch):
    saved = {}

    class Counted(chat.Workspace):
        def save(self, df, name):
            out = super().save(df, name)
            saved[name] = out.count()
            return out

    monkeypatch.setattr(chat, "Workspace", Counted)
    df = spark.range(100).selectExpr("id % 2 AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    assert [r.n_turns for r in chat.format_trees(chat.threads(df)).collect()] == [50, 50]
    assert len(saved) == 3 + 6  # nodes, links, leaves, and a table a round: 2 ** 6 >= 50
    steps = sum(n for name, n in saved.items() if name.startswith(("leaves", "steps")))
    links = sum(2 * max(50 - 2**k, 0) for k in range(1, 7))
    assert steps == 100 + links  # each node of a path once


def test_chat_loops_are_cut_and_null_trees_kept(spark):
    nodes = [
        (1, 1, 2, "u", "a", 0.0),  # 1 -> 2 -> 3 -> 1: 1 becomes the root
        (1, 2, 3, "u", "b", 0.0),
        (1, 3, 1, "u", "c", 0.0),
        (1, 9, 2, "u", "d", 5.0),  # a branch that leads into the loop
        (2, 7, 8, "u", "e", 0.0),
        (2, 8, 7, "u", "f", 0.0),
        (3, 1, None, "u", "g", 0.0),
        (None, 1, None, "u", "h", 0.0),
        (None, 2, 1, "u", "i", 0.0),
    ]
    found = chat.format_trees(spark.createDataFrame(nodes, NODE), top=3).collect()
    got = {(r.tree, r.leaf): "".join(re.findall(r"\n(.)<", r.formatted)) for r in found}
    assert got == {(1, 9): "acbd", (2, 8): "ef", (3, 1): "g", (None, 2): "hi"}
    rows = [(None, 1, "user", "x"), (None, 0, "user", "w"), (4, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted((str(r.tree), r.n_turns) for r in chat.format_trees(chat.threads(df)).collect()) == [("4", 1), ("None", 2)]


# --- all ---------------------------------------------------------------------------------------------------------------

ALL = {
    "exact": exact_dedup.exact_dedup,
    "shards": sharding.shard_by_bytes,
    "pack": lambda df: packing.pack(df, tokenizer_path=WORDS),
    "bpe": lambda df: byte_bpe.encode_documents(df, ranks_path=RANKS, pattern=public_tokenizers.PATTERN),
    "language": lambda df: language_id.identify(df, dims=64),
    "near": near_dedup.near_components,
    "near rows": near_dedup.near_dedup,
    "lines": line_dedup.line_dedup,
    "fingerprints": fingerprints.edited_fingerprints,
    "licences": licences.scan,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(empty, name):
    assert ALL[name](empty).collect() == []


@pytest.mark.parametrize("name", ALL)
def test_clashing_columns_change_nothing(docs, clashing, name):
    own = ALL[name](docs)
    columns = [c for c in own.columns if c not in ("row", "sequence_id", "first", "kept")]
    assert Counter(map(str, own.select(columns).collect())) == Counter(map(str, ALL[name](clashing).select(columns).collect()))


def test_chat_empty(spark):
    assert chat.format_trees(spark.createDataFrame([], NODE)).collect() == []
