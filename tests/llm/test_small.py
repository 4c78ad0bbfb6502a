"""Small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, and brute-force versions."""

import functools
import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustline.llm import byte_bpe, common, ivf_pq, jump_shards, language_id, mixing, near_dup, nn_descent, passages, toxicity
from dustline.llm.common import Words, collect_garbage, components, table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
words = lambda rng, n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


def test_bpe_equals_the_library(spark):
    lib = byte_bpe.encoding(*byte_bpe.default_ranks())
    texts = ["", None, "a  b", " x", "Don't  stop!\n\n  now 12 3", "é " * 30, "a" * 5000, "\x85 x　 y", "x  y", "<|endoftext|> hi", "tab\t end ", "😀 ok"]
    got = byte_bpe.decode(byte_bpe.encode(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), keep=["doc_id"])).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == lib.encode_ordinary(t or "")
        assert bytes(r["decoded"]) == (t or "").encode()


def test_long_texts_are_cut_safely_and_decoded_by_the_same_worker(spark):
    rng, lib = np.random.default_rng(5), byte_bpe.encoding(*byte_bpe.default_ranks())
    parts = [" ", "  ", "\n", "\t ", "ab", "é", "　", "7", "!?", "'s", "😀", "\x85", "zz "]
    texts = ["".join(rng.choice(parts, 3000)) for _ in range(20)]
    for t in texts:
        chunks = list(byte_bpe.safe_chunks(t, 50))
        assert "".join(chunks) == t and len(chunks) > 20
        assert [i for c in chunks for i in lib.encode_ordinary(c)] == lib.encode_ordinary(t)
    long = docs(spark, [(0, texts[0] * 10, None), (1, "", None), (2, None, None), (3, "x" * 40_000, None)])
    for r, t in zip(byte_bpe.encode(long, keep=["doc_id"], decoded=True).orderBy("doc_id").collect(), [texts[0] * 10, "", "", "x" * 40_000]):
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == lib.encode_ordinary(t)
        assert bytes(r["decoded"]) == t.encode() and r["n_tokens"] == len(r["token_ids"]) // 4


def test_very_long_runs_of_white_space(spark):
    coder, lib = byte_bpe.Coder(*byte_bpe.default_ranks()), byte_bpe.encoding(*byte_bpe.default_ranks())
    small = ["a" + c * n + end for c in (" ", "\n", "\u3000", " \t") for n in (2100, 4095, 4096, 4097, 9000) for end in ("", "x", " x", "\nx", "7", "'s")]
    small += ["\x1c" * 5000 + "a", "x" + " " * 5000 + "\n" * 5000 + "é"]
    for t in small:  # short enough for the library's own engine
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == lib.encode_ordinary(t)
    texts = [" " * 2_000_000 + "x", "\n" * 2_000_000, "y" + "\n \t" * 700_000 + " z", "w" * 300_000]
    got = byte_bpe.encode(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), keep=["doc_id"], decoded=True).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in got] == texts
    # a run but for its last character is one match of the pattern, hence one piece
    assert np.frombuffer(bytes(got[0]["token_ids"]), "<u4").tolist() == lib._encode_single_piece(b" " * 1_999_999) + lib.encode_ordinary(" x")
    assert np.frombuffer(bytes(got[1]["token_ids"]), "<u4").tolist() == lib._encode_single_piece(b"\n" * 2_000_000)


def test_jump_shards_move_rows_only_into_the_new_one(spark):
    df = docs(spark, [(i, "x", None) for i in range(500)] + [(None, None, None), (7, "x", None)])
    rows = jump_shards.shard(df.select("doc_id", "text"), 10).collect()
    assert len(rows) == 502
    assert all(r["grown_shard"] in (r["shard"], 10) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    key, b, j = 12345, -1, 0
    while j < 10:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    assert jump_shards.jump(np.array([12345], np.uint64), 10)[0] == b


def test_mix_meets_targets_and_caps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, words(rng, int(rng.integers(1, 200))), f"s{min(i % 7, 3)}") for i in range(300)] + [(900, None, None), (901, "", "s0"), (902, "one two", None)]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - 1.5 * total) < 1e-6 * total
    for s in {r["source"] for r in out}:
        part = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 2 * mixing.BLOCK


def test_mix_of_rows_without_ids_and_with_clashing_columns(spark):
    rng = np.random.default_rng(17)
    rows = [(None, words(rng, 30), "s0", 1, 2) for _ in range(50)] + [(7, words(rng, 30), "s1", 1, 2) for _ in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size bigint, target bigint")
    once, again = (sorted(map(tuple, mixing.mix(df, shard_words=200).select("doc_id", "text", "taken").collect()), key=repr) for _ in range(2))
    assert once == again and len(once) == 100
    assert sorted(mixing.mixed_documents(df).columns) == sorted(df.columns)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("block", [None, (3, 1 << 20), (1024, 250)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    if block:  # no stars, so blocks of few members or few shingles do what is left
        monkeypatch.setattr(near_dup, "BLOCK", block[0])
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block[1])
        monkeypatch.setattr(near_dup, "grouped", functools.partial(near_dup.grouped, stars=0))
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for g in range(12):
        base = words(rng, int(rng.integers(3, 120))).split()
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 25))):
                t[int(rng.integers(len(t)))] = "zzz"
            rows.append((n, " ".join(t), None))
            n += 1
    rows += [(n, "", None), (n + 1, None, None), (n + 2, " \t\n", None), (n + 3, "A b", None), (n + 4, "a  B", None), (0, rows[0][1], None)]
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    sets = {i: set(Words(t).shingles().tolist()) for i, t, _ in rows}
    root = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == root
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    b = np.concatenate((a[:900], rng.integers(0, 2**64, 100, dtype=np.uint64)))
    x, y = near_dup.odd_sketch(near_dup.minhash(np.concatenate((a, b)), np.array([1000, 1000])))
    assert abs(near_dup.similarity_of_bits(int(np.bitwise_count(x ^ y).sum())) - 900 / 1100) < 0.08


def test_samples_of_short_and_long_sets_equal_plain_ones():
    rng = np.random.default_rng(31)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 3, 60, 257, 256, 2000, 5, 511, 513, 1)]
    got = near_dup.minhash(np.concatenate(sets), np.array([len(s) for s in sets]))
    for s, row in zip(sets, got):
        x = (s >> np.uint64(32)).astype(np.uint32)
        assert row.tolist() == [int(((x ^ a) * b).min()) for a, b in zip(near_dup._XOR, near_dup._MUL)]
    made = near_dup.signed([np.concatenate((sets[2], sets[2][:9])), sets[0][:0], sets[2][::-1]])
    assert made["n"].to_pylist() == [60, 0, 60] and made["keys"][0] == made["keys"][2] and made["h2"][0] == made["h2"][2] and made["keys"][1].as_py() == []


def test_passages_are_found_wherever_they_stand(spark):
    rng = np.random.default_rng(4)
    shared = words(rng, 60)
    rows = [(i, f"{words(rng, 80)} {words(rng, 7)}\n{words(rng, 30)}", None) for i in range(8)]
    rows += [(20, f"{words(rng, 40)} {shared} {words(rng, 40)}", None), (21, f"{words(rng, 13)}\n{words(rng, 5)} {shared}", None), (22, shared, None), (23, None, None), (24, "", None)]
    found = passages.repeated_passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == {20, 21, 22}
    # lines 21 and 22 are also similar as lines, whose first one is 21; of the stretch itself the first place is in 20
    assert {r["doc_id"] for r in found if r["kept"] and r["n_words"] == 60} == {20}
    out = {r["doc_id"]: r["text"] for r in passages.dedup(docs(spark, rows)).collect()}
    assert 22 not in out and shared not in out[21] and shared in out[20]
    assert all(out[i] == t for i, t, _ in rows if i not in (21, 22))


def test_cutting_keeps_all_other_characters():
    assert passages.without("a b  c d", [(1, 2)]) == "a d"
    assert passages.without("a b", [(0, 2)]) == ""


def test_vectors_and_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[10] = x[11] = x[12]
    x[20] = x[21] + 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert len(got) == len(rows) and all(got[i]["n_links"] == links[i] for i in range(300))
    assert got[12]["component_id"] == 10 and got[1000]["kept"] and got[1001]["n_links"] == 0
    v = ivf_pq.clean(df)
    q = ivf_pq.fit(v)
    found, true = ivf_pq.search(v, v.where("id % 50 = 0"), q), ivf_pq.brute_force(v, v.where("id % 50 = 0"))
    assert ivf_pq.audit(found, true) >= 0.9
    d = np.sqrt(((x[100].astype(float) - x.astype(float)) ** 2).sum(1))
    assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-9 for r in found.where("query_id = 100").collect())


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.integers(97, 105, (80, 128)), rng.integers(105, 113, (80, 128)))).astype(np.uint8)
    net = language_id.Network(["a", "b"], 4)
    net.learn(x, np.repeat([0, 1], 80), steps=30, size=32, length=16)
    p = net.narrowed().documents(["abcdefg" * 40, "ijklmnop" * 40, "", "12 34", None, "ab"])
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and not p[2:5].any() and p[5].sum() == pytest.approx(1, abs=1e-4)


def test_languages_are_learnt_whatever_the_ids_are(spark):
    rng = np.random.default_rng(21)
    say = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))
    texts = [(say("abcdef"), "aa") for _ in range(60)] + [(say("uvwxyz"), "bb") for _ in range(60)] + [(say("uvwxyz"), None), ("", "aa"), (None, "bb"), ("12 34", "aa")]
    for ids in (lambda k: None, lambda k: 1, lambda k: 3, lambda k: k):
        d = spark.createDataFrame([(ids(k), t, lang, None, 0.5, "x") for k, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string, source string, score double, lang_pred string")
        net = language_id.fit(d.where(~language_id.held_out(3, 1)), steps=60)
        got = language_id.predict(d, net).collect()
        assert len(got) == len(texts)
        if net is None:  # crc32("1") % 3 is 1, so all rows are held out and nothing can be learnt
            assert {r["lang_pred"] for r in got} == {"und"}
            continue
        assert all(r["lang_pred"] == ("und" if not r["text"] or r["text"] == "12 34" else "aa" if r["text"][0] < "m" else "bb") for r in got)
    one = spark.createDataFrame([(7, texts[0][0], "aa")] * 500, "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language_id.predict(one, language_id.fit(one, steps=5)).collect()} == {"aa"}


def test_toxic_words_are_learnt(spark):
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, 40) + (" blorg wuzzle" if i % 3 == 0 else ""), None) for i in range(240)] + [(999, None, None), (1000, "", None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    scorer = toxicity.fit(docs(spark, rows), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, rows), scorer, keep=["doc_id"]).collect()}
    assert sum(got[i] == int(i % 3 == 0) for i in range(200, 240)) >= 38 and got[999] == 0
    none = toxicity.fit(docs(spark, rows), labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs(spark, rows), none, keep=["doc_id"]).collect()} == {0.0}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (7, 8), (5, 5)], "a bigint, b bigint")
    assert {r["id"]: r["component"] for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7}


def test_empty_tables(spark):
    d = docs(spark, [])
    assert byte_bpe.encode(d, keep=["doc_id"]).count() == 0
    assert near_dup.near_duplicates(d).count() == 0
    assert passages.dedup(d).count() == 0
    assert mixing.mix(d).count() == 0
    assert jump_shards.shard(d.select("doc_id"), 4).count() == 0
    assert language_id.predict(d, language_id.fit(d)).count() == 0
    v = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert nn_descent.near_duplicates(v).count() == 0
    assert ivf_pq.search(ivf_pq.clean(v), ivf_pq.clean(v), ivf_pq.fit(ivf_pq.clean(v))).count() == 0


def test_digests_follow_the_ids(spark):
    lib = byte_bpe.encoding(*byte_bpe.default_ranks())
    ids = np.asarray(lib.encode_ordinary("Some words here."), "<u4").tobytes()
    assert hashlib.sha256(byte_bpe.Coder(*byte_bpe.default_ranks()).encode("Some words here.")).hexdigest() == hashlib.sha256(ids).hexdigest()


def test_passages_equal_brute_force_where_the_first_place_differs(spark):
    rng, least = np.random.default_rng(12), passages.LEAST
    rows, n = [], 0
    for g in range(6):  # copies of one text that are edited at places of their own, so that a bucket's first place is often unlike the others there
        base = words(rng, 240).split()
        for _ in range(9):
            t = list(base)
            for at in rng.integers(0, len(t), int(rng.integers(2, 6))):
                t[at] = words(rng, 1)
            rows.append((n, "\n".join(" ".join(t[k : k + 30]) for k in range(0, len(t), 30)), None))
            n += 1
    core, left, right = words(rng, 34), words(rng, 15), words(rng, 15)  # documents 900 and 901 share 64 words with each other, under 50 with the first
    rows += [(800, f"{words(rng, 20)}\n{core}\n{words(rng, 20)}", None)] + [(900 + k, f"{words(rng, 9)}\n{left}\n{core}\n{right}\n{words(rng, 9)}", None) for k in range(2)]
    for k in range(40):  # exactly `least` words
        shared = [words(rng, 25), words(rng, 25)]
        rows += [(1000 + 2 * k + j, "\n".join([words(rng, 9), *shared, words(rng, 9)]), None) for j in range(2)]
    first = {}
    for i, t, _ in rows:
        w = t.split()
        for p in range(len(w) - least + 1):
            first.setdefault(tuple(w[p : p + least]), i)
    want, got = {}, {}
    for i, t, _ in rows:
        w = t.split()
        want[i] = {q for p in range(len(w) - least + 1) if first[tuple(w[p : p + least])] != i for q in range(p, p + least)}
    for r in passages.repeated_passages(docs(spark, rows)).where("NOT kept").collect():
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert want[901] and all(got.get(i, set()) == want[i] for i in want)


def test_lines_meet_also_where_both_are_unlike_the_first(spark):
    rng = np.random.default_rng(13)
    rows, n = [], 0
    for g in range(8):  # a template that all share (about 0.4 alike), filled in two ways that are alike only among themselves
        shared = words(rng, 45)
        rows.append((n, f"{shared} {words(rng, 30)}", None))
        for fill in (words(rng, 30), words(rng, 30)):
            rows += [(n + 1 + k, f"{shared[:-6]} {words(rng, 1)} {fill}", None) for k in range(3)]
            n += 3
        n += 1
    sets = {i: set(Words(t).shingles().tolist()) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    keeper = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            keeper[a] = keeper[b] = min(keeper[a], keeper[b])
    got = {r["doc_id"]: r["keeper_doc_id"] for r in passages.repeated_passages(docs(spark, rows)).where("first_word = 0 AND n_words = 75").collect()}
    assert len(links) == 48 and got == {i: keeper[i] for p in links for i in p}


def test_saturated_groups_keep_their_links_to_each_other(spark):
    rng = np.random.default_rng(14)

    def group(centre, n):
        v = centre + 0.0115 * rng.standard_normal((n, 32))
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    e = np.eye(32)
    x = [group(e[0], 300), group(0.93 * e[0] + np.sqrt(1 - 0.93**2) * e[1], 300), group(e[5], 300), group(0.8 * e[5] + 0.6 * e[6], 300)]
    x = np.concatenate(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    near = x @ x.T >= 0.9
    assert near[:300, 300:600].mean() > 0.9 and not near[600:900, 900:].any()
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(df).collect()}
    assert all(got[i]["n_links"] == near[i].sum() - 1 and got[i]["component_id"] == (0, 0, 600, 900)[i // 300] for i in range(len(x)))


def test_vectors_of_very_many_lengths_all_find_their_like(spark):
    rng = np.random.default_rng(15)
    rows = []
    for d in range(2, 82):
        v = rng.standard_normal(d)
        rows += [(2 * d, v.tolist()), (2 * d + 1, (v * 1.5 + 1e-3).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(df).collect()}
    assert all(got[i]["n_links"] == 1 and got[i]["component_id"] == i - i % 2 for i, _ in rows)


def test_descent_over_many_cells_finds_links_that_few_deals_miss(spark, monkeypatch):
    rng = np.random.default_rng(23)
    centre = rng.standard_normal((650, 24))
    x = np.concatenate([centre + 0.16 * rng.standard_normal(centre.shape) for _ in range(8)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(nn_descent, "deals", lambda n, threshold, missed=0, most=0: (5, 2))
    shares = []
    for rounds in (0, 5):
        got = {r["vec_id"]: r["n_links"] for r in nn_descent.descended(df, rounds=rounds).collect()}
        assert all(got[i] <= near[i].sum() for i in got)  # no link under the threshold
        shares.append(sum(got.values()) / near.sum())
    assert shares[0] < 0.95 and shares[1] > shares[0] + 0.01
    monkeypatch.undo()
    full = nn_descent.near_duplicates(df)
    assert sum(r["n_links"] for r in full.collect()) / near.sum() >= 0.99 and nn_descent.audit(df, full) >= 0.95


def test_the_driver_gives_freed_native_memory_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", open(f"/proc/{pid}/smaps_rollup").read())[1]) / 1024
    many = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # each has over 128 KB outside the heap
    for x in many[:10] + [y for i, y in enumerate(many) if i >= 10 and i % 50]:  # those that stay keep the C library from giving back the rest by itself
        x.end()
    for _ in range(2):
        jvm.System.gc()
    before = held()
    collect_garbage(spark, 0)
    assert before - held() > 60
    for x in many:
        x.end()


def test_a_table_leaves_no_shuffle_files(spark, monkeypatch):
    jvm = spark._jvm

    def files():
        them = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = set()
        while them.hasNext():
            out.add(them.next().getName())
        return {x for x in out if x.startswith("shuffle_")}

    monkeypatch.setattr(common, "collect_garbage", lambda *_: None)
    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    got = table(df)
    for _ in range(20):  # executors delete them by themselves
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert got.count() == df.count() == 7  # what is run again is made again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_few_edges_are_joined_in_few_jobs_and_many_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(31)
    at = rng.permutation(600).astype(np.int64) - 300
    a, b = np.concatenate((at[:200], at[300:500], [7, 8])), np.concatenate((at[1:201], at[rng.integers(300, 600, 200)], [7, 8]))
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist()), (None, 1), (1, None)], "a bigint, b bigint")
    sc = spark.sparkContext
    sc.setJobGroup("few edges", "")
    few = {tuple(r) for r in components(df).collect()}
    assert len(sc.statusTracker().getJobIdsForGroup("few edges")) <= 6
    sc.setLocalProperty("spark.jobGroup.id", None)
    label = {int(i): int(i) for i in np.concatenate((a[a != b], b[a != b]))}
    for _ in range(400):
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
            label[x] = label[y] = min(label[x], label[y])
    assert few == set(label.items())
    monkeypatch.setattr(common, "FEW_EDGES", 0)
    assert {tuple(r) for r in components(df).collect()} == few
    assert components(df.where("a = b")).count() == 0


def test_lines_count_words_as_the_word_rule_does():
    text = "a b\tc\n\n \x0b\x0c\rd\x85e \x1c f\u2003g\n h"
    assert passages.lines(text).tolist() == [[0, 3], [3, 3], [6, 1]]
    assert passages.lines("").shape == (0, 2)
