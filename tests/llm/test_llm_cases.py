"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
extra columns, against brute force, for every operator."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from claimlens.llm import (
    exact_dedup, html_extract, line_dedup, minhash, mixing, pii_crf, quality, sentencepiece_bpe, suffix_dedup, token_counts)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SHARED = "a passage that several of the documents share, word for word, with more than fifty bytes in it"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, h long, row string, id string, key string, "
          "label double, slot int, sha binary, settled boolean, kept string")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def texts() -> list[tuple]:
    prose = " ".join(f"word{i % 97}x{i}" for i in range(400))
    edited = prose.replace("word3x3 ", "other ").replace("word50x147 ", "changed ")
    noisy = " ".join(f"w{i}###$$$" for i in range(80))
    return [
        (1, prose, "en", "a"), (2, prose, "en", "b"), (3, edited, "en", "a"), (4, prose.upper(), "en", "a"),
        (5, None, "en", "a"), (6, "", None, "a"), (7, " \n\t ", "en", None), (8, "one two", "de", "b"), (9, "one two", "de", "c"),
        (9, "one two", "de", "c"), (10, SHARED + " 1", "en", "a"), (11, "x " + SHARED, "en", "b"), (12, SHARED, "en", "c"),
        (None, "no id here " + SHARED, "en", "a"), (None, None, None, None), (13, noisy, "en", "a"),
        (14, "same words again " * 60, "en", "a"), (15, "é中😀 mixed text▁end " * 30, "fr", "a"),
        (16, "q" * 6000 + " " + prose * 3, "en", "b"), (17, "line one\nline one\n\nline two\nline one", "en", "a"),
        (18, "mail a.b@c.example.org or 10.1.2.3, +1 (415) 555-0132; 4111111111111111", "en", "a"),
        (20, prose, "en", "a"), (20, prose, "en", "a"),
    ]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = (1, "r", "i", "k", 0.5, 3, b"s", True, "no")
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_copies(docs, rows):
    def brute():
        for i, t, *_ in rows:
            same = [j for j, u, *_ in rows if (u or "") == (t or "")]
            yield i, max((j for j in same if j is not None), default=None), len(same), sha(t or "")
    want = sorted(brute(), key=repr)
    assert by_row(exact_dedup.exact_copies(docs)) == want
    # Colliding hashes make chains; small buckets make the directory double.
    assert by_row(exact_dedup.exact_copies(docs, hash_bits=2, capacity=1)) == want


def test_directory_doubles_until_buckets_fit(spark):
    from claimlens.llm.common import Stages
    entries = spark.range(2000).select(F.xxhash64("id").alias("h"))
    buckets, depth, total = exact_dedup.directory(entries, Stages(spark), 50)
    got = buckets.collect()
    assert total == 2000 and sum(b.n_entries for b in got) == 2000 and max(b.n_entries for b in got) <= 50
    assert len({(b.prefix, b.depth) for b in got}) == len(got) and depth == max(b.depth for b in got)
    index = exact_dedup.build_index(entries, Stages(spark), 50)
    assert index.count() == 2000
    assert index.filter(F.shiftrightunsigned("h", 0).isNull()).count() == 0
    assert all(r.h >> (64 - r.depth) & (1 << r.depth) - 1 == r.bucket for r in index.collect())


def test_drop_copies_keeps_one_row_of_each_text(docs, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(t or "" for _, t in kept) == sorted({t or "" for _, t, *_ in rows})
    for i, t in kept:
        assert i == max((j for j, u, *_ in rows if (u or "") == (t or "") and j is not None), default=None)


def quality_base(text: str):
    ws = WORD.findall(text)
    tri = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
    covered = {k + j for k, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_and_verdicts(docs, rows):
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == sorted(((i, *quality_base(t or "")) for i, t, *_ in rows), key=repr)
    kept = {r.doc_id for r in got.collect() if r.kept}
    assert 1 in kept and 13 not in kept and 14 not in kept and 5 not in kept
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i, *_ in rows if i in kept)


def components_brute(rows):
    sets = []
    for _, t, *_ in rows:
        ws = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(ws[k:k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else []))
    label = list(range(len(rows)))
    change = True
    while change:
        change = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and label[a] > label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a], change = label[b], True
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        c = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("short_list", [0, 12])
def test_near_copies(docs, rows, short_list, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT_LIST", short_list)  # 0: all lists go by hubs and exact prefixes
    assert by_row(minhash.near_copies(docs)) == components_brute(rows)


def test_near_copies_in_a_large_group(spark, monkeypatch):
    import random
    random.seed(5)
    base = [f"w{random.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(120):
        ws = list(base)
        for _ in range(random.randint(0, 8)):
            ws[random.randrange(150)] = f"e{random.randint(0, 10**6)}"
        rows.append((i * 3, " ".join(ws)))
    monkeypatch.setattr(minhash, "SHORT_LIST", 4)
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)  # leaves much to the exact prefixes
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(minhash.near_copies(docs)) == components_brute(rows)


def test_drop_near_copies(docs, rows):
    got = minhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = {i for i, _, _, k in components_brute(rows) if k}
    assert {r.doc_id for r in got.collect()} == kept


def test_mixing_windows_and_rows(docs, rows):
    got = mixing.mixed_slots(docs, block_rows=2, resolution=10).collect()
    assert sorted((r.doc_id, r.source) for r in got if r.doc_id and r.source) == sorted((i, s) for i, _, _, s in rows if i and s)
    assert len(got) == len(rows) and all(r.release <= r.slot < r.deadline for r in got)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


def test_mixing_deviation_is_below_one_block(spark):
    units = {"a": 7, "b": 3, "c": 2, "d": 1}
    target = spark.createDataFrame(list(units.items()), "source string, units long")
    docs = spark.createDataFrame([(k * 1000 + i, s) for k, s in enumerate(units) for i in range(130)], "doc_id long, source string")
    got = mixing.mixed_slots(docs, target=target, block_rows=1).collect()
    of = {r.slot: r.source for r in got}
    total, seen = sum(units.values()), dict.fromkeys(units, 0)
    for t in range(130 * total // 7):  # until the first source runs out
        seen[of[t]] += 1
        for s, u in units.items():
            assert abs(seen[s] * total - (t + 1) * u) < total


def test_mixing_weights_of_many_sources(spark):
    counts = spark.createDataFrame([("big", 10_000_000), *((f"s{k}", 10_000) for k in range(300))], "source string, n_rows long")
    units = {r.source: r.units for r in mixing.weights(counts).collect()}
    total = sum(units.values())
    share = 10_000_000 ** 0.5 / (10_000_000 ** 0.5 + 300 * 100)
    assert total == 301 * mixing.SOURCE_UNITS and abs(units["big"] / total - share) < 1 / total
    assert {units[f"s{k}"] for k in range(300)} <= {45, 46}


def test_pipeline_ends_in_mixed_order(spark, tmp_path):
    import corpus_pipeline
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}") for i in range(900)],
                                 "doc_id long, text string, lang string, source string").repartition(5)
    corpus_pipeline.encoded(spark, docs, "").write.parquet(str(tmp_path / "out"))
    got = [i for f in sorted((tmp_path / "out").glob("part-*")) for i in (r.doc_id for r in spark.read.parquet(str(f)).collect())]
    assert got == [r.doc_id for r in mixing.mixed_slots(docs).orderBy("slot", "place").collect()] and len(got) == 900


def schedule_brute(units):
    """Earliest deadline first, a source at a time; ties go to the source that sorts first, null before all."""
    names = sorted(units, key=lambda s: (s is not None, s or ""))
    total, done, out = sum(units.values()), dict.fromkeys(units, 0), []
    for t in range(total):
        _, _, s = min((-(-(done[s] + 1) * total // units[s]), i, s) for i, s in enumerate(names)
                      if done[s] < units[s] and done[s] * total // units[s] <= t)
        out.append((s, done[s], t, total))
        done[s] += 1
    return sorted(out, key=lambda r: r[2])


def test_mixing_schedule_equals_brute_force(spark):
    for units in ({"a": 7, None: 3, "c": 3, "d": 1, "e": 7, "f": 3}, {"only": 4}, {f"s{k % 7}{k}": 1 + k % 5 * 3 for k in range(60)}):
        table = spark.createDataFrame(list(units.items()), "source string, units long")
        got = sorted((tuple(r) for r in mixing.schedule(table).collect()), key=lambda r: r[2])
        assert got == schedule_brute(units)


def test_sentencepiece_equals_the_library(docs, rows):
    m = sentencepiece_bpe.model(sentencepiece_bpe.default_model())
    got = sentencepiece_bpe.encode_rows(docs, ["doc_id", "row", "kept"]).collect()

    def want(t):
        ids = m.lib.encode(t or "") + [m.lib.eos_id()]
        return ids, m.lib.decode(ids)
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(((i, *want(t)) for i, t, *_ in rows), key=repr)
    digests = sentencepiece_bpe.encode_rows(docs, ["doc_id"], digests=True)
    assert by_row(digests) == sorted(((i, len(want(t)[0]), sha(" ".join(map(str, want(t)[0]))), sha(want(t)[1])) for i, t, *_ in rows), key=repr)


def test_sentencepiece_odd_texts():
    import random
    random.seed(2)
    m = sentencepiece_bpe.MergeModel(sentencepiece_bpe.default_model())
    parts = ["a", "b", " ", "  ", "the", "é", "中", "\n", "▁", "😀", "́", "x" * 30, "\x00", "<s>", "</s>", "<0x0A>", " " * 40, "ing", "ﷺ"]
    odd = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(1500)] + [" ", "▁", "▁ ▁", "a" * 3000]
    assert m.encode(odd) == m.lib.encode(odd)
    for chunk in ["▁the", "▁ab中", "▁xxing"]:
        assert m.by_heap(chunk) == m.by_table([chunk])[0]


def test_sentencepiece_kept_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_CHUNKS", 50)
    m = sentencepiece_bpe.MergeModel(sentencepiece_bpe.default_model())
    for k in range(12):
        batch = [f"word{k}a{i} and some more" for i in range(20)]
        assert m.encode(batch) == m.lib.encode(batch)
        assert len(m.kept) <= 50


def removed_brute(rows):
    out = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        earlier = [u for j, u, *_ in rows if j is not None and (i is None or j < i)]
        seen = {u.encode()[k:k + 50] for u in earlier if u for k in range(len(u.encode()) - 49)}
        gone = {k + d for k in range(len(data) - 49) if data[k:k + 50] in seen for d in range(50)}
        kept = bytes(b for k, b in enumerate(data) if k not in gone)
        runs = sum(k in gone and k - 1 not in gone for k in range(len(data)))
        out.append((i, len(data), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(docs, rows):
    got = suffix_dedup.removed_spans(docs)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == removed_brute(rows)


def test_suffix_dedup_of_random_pieces(spark, monkeypatch):
    import random
    from claimlens.llm import hashing
    monkeypatch.setattr(hashing, "PIECE", 400)
    random.seed(9)
    parts = ["".join(random.choices("ab ", k=random.randint(20, 90))) for _ in range(12)] + ["é" * 40, "z" * 70]
    rows = [(random.randint(0, 30), "".join(random.choices(parts, k=random.randint(0, 6)))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (suffix_dedup.HOT, 0, 3):  # all anchors by window, or those of more than three documents
        got = suffix_dedup.removed_spans(docs, hot_docs=hot)
        assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == removed_brute(rows)


def test_suffix_dedup_of_a_common_phrase(spark):
    """100,000 documents with the same 26 bytes in other words each; every thousandth repeats one from before."""
    phrase = "as everybody here may know"
    own = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    rows = [(k, f"{own(k)}{phrase}{own(-k - 1)}") for k in range(100_000)]
    rows += [(100_000 + k, f"{k} {own(k)}{phrase} {k}") for k in range(0, 100_000, 1000)]
    got = {r.doc_id: r for r in suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == len(rows)
    assert all(got[k].n_removed == 0 for k in range(100_000))
    for k, text in rows[100_000:]:
        begin = len(f"{k - 100_000} ")
        assert got[k].spans == [begin, begin + 32 + len(phrase)] and got[k].n_bytes == len(text)


@pytest.mark.parametrize("parts", [3, 24])
def test_suffix_dedup_rows_follow_the_documents(spark, monkeypatch, parts):
    """The stages between hold a row for each bucket and block of documents, whatever the partitions."""
    from claimlens.llm.common import Stages
    write, counted = Stages.write, {}

    def counting(self, df, name, *more):
        out = write(self, df, name, *more)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(Stages, "write", counting)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = []
        for n in (300, 1500):
            rows = [(k, f"{k} " + "a line that all the documents of this test repeat in full, so it goes. " * 2 + f"{k * k}") for k in range(n)]
            found = suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
            assert found.filter("n_removed > 100").count() == n - 1
            made.append({name: counted[name] for name in ("live", "spans")})
        assert all(big <= 4 for big in made[1].values()), made
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_longest_previous_factor():
    import numpy as np
    rng = np.random.default_rng(3)
    window = rng.integers(0, 2, (200, 12)).astype(np.uint8)
    when = rng.integers(0, 40, 200)
    got = suffix_dedup.longest_previous_factor(window, when)
    for i in range(200):
        best = 0
        for j in np.flatnonzero(when < when[i]):
            same = window[i] == window[j]
            best = max(best, 12 if same.all() else int(same.argmin()))
        assert got[i] == best


def test_spread_lines(spark, rows):
    wide = [(100 + k, f"own {k}\nboilerplate\n\n boilerplate", "en", f"s{k}") for k in range(9)]
    few = [(200 + k, f"seldom\nown too {k}", "en", f"s{k % 7}") for k in range(30)]
    every = rows + wide + few
    docs = spark.createDataFrame([r[:4] for r in every], "doc_id long, text string, lang string, source string")
    sites = {}
    for _, t, _, s in every:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                sites.setdefault(x, set()).add(s)

    def want(i, t):
        lines = (t or "").split("\n")
        gone = [bool(WORD.search(x)) and len(sites[x]) >= 8 for x in lines]
        return i, sum(bool(WORD.search(x)) for x in lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))
    assert by_row(line_dedup.remove_spread_lines(docs)) == sorted((want(r[0], r[1]) for r in every), key=repr)
    full = line_dedup.remove_spread_lines(docs, with_text=True)
    assert all(sha(r.text) == r.kept_sha256 for r in full.collect())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_brute(text: str):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii_crf.luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_personal_data_base(docs, rows):
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii_crf.personal_data(docs).collect()}
    want = set()
    for i, t, *_ in rows:
        spans = base_brute(t or "")
        want.add((i, sha(",".join(f"{pii_crf.KINDS[k]}:{s}:{e}" for s, k, e in spans)), *(sum(k == x for _, x, _ in spans) for k in range(4))))
    assert got == want


def test_personal_data_patterns_on_random_strings():
    import random
    random.seed(4)
    for _ in range(20_000):
        x = "".join(random.choices("a@.1@.-b2+ ()49", k=random.randint(0, 30)))
        assert base_brute(x) == pii_crf.base_spans(x), x


def test_tagger_finds_held_out_secrets_and_leaves_prose_alone(spark):
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(8)
    alnum = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    secrets = ["AKIA" + "".join(rng.choice(alnum, 16)) for _ in range(60)]
    secrets += ["password=" + "".join(rng.choice(list("0123456789abcdef"), 18)) for _ in range(60)]
    quoted = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    texts = [f"some words before {s} and after." for s in secrets] + [f'here token = "{s}" ends' for s in quoted]
    plain = ["In 2019 we sold 1,250 units at 19.99 each, see page 14.", "version 2.0, section 3.1 (p. 7)", "no digits at all here"] * 20
    field = pii_crf.train()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts + plain))), pa.array(texts + plain)], names=["id", "text"])
    got = [r for b in pii_crf._tag(field.own, field.step)([batch]) for r in b.to_pylist()]
    hits = 0
    for t, s, r in zip(texts, secrets + quoted, got):
        hits += f"secret:{t.index(s)}:{t.index(s) + len(s)}" in r["spans"].split(",")
    assert hits >= 0.95 * len(texts)
    assert sum(bool(r["spans"]) for r in got[len(texts):]) == 0


def test_viterbi_equals_enumeration():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    field = pii_crf.Field(np.zeros((3, pii_crf.WIDTH, 6)), rng.normal(size=(6, 6)))
    sizes = np.array([1, 4, 2, 3, 4, 1])
    begin = np.cumsum(sizes) - sizes
    scores = rng.normal(size=(sizes.sum(), 6))
    got = pii_crf.viterbi(field, scores, begin, sizes)
    for b, n in zip(begin, sizes):
        def total(path):
            way = [0, *path, 0]
            return sum(scores[b + k, x] for k, x in enumerate(path)) + sum(field.step[x, y] for x, y in zip(way, way[1:]))
        best = max(itertools.product(range(6), repeat=n), key=total)
        assert tuple(got[b:b + n]) == best


def test_token_counts(docs, rows, spark, tmp_path):
    enc = token_counts.encoding(token_counts.default_ranks())
    want = sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t, *_ in rows), key=repr)
    assert by_row(token_counts.document_tokens(docs)) == want
    path = str(tmp_path / "flat")
    token_counts.write_tokens(docs, path)
    for block in (2, 14, 64, 1 << 20):  # documents over many blocks, keys over borders
        got = token_counts.token_counts(spark, path, token_counts.KEY_WIDTH, block_bytes=block)
        assert sorted(((r.key, r.n_tokens) for r in got.collect()), key=repr) == want


def test_token_counts_of_plain_files(spark, tmp_path):
    import numpy as np
    path = tmp_path / "plain"
    path.mkdir()
    end = token_counts.END
    np.array([1, 2, end, end, 3, end, 4, 5, 6], "<u2").tofile(path / "a.bin")
    (path / "b.bin").write_bytes(np.array([7, end], "<u2").tobytes() + b"x")
    (path / "c.bin").write_bytes(b"")
    for block in (2, 4, 6, 100):
        got = sorted((r.file[-5:], r.document, r.start, r.n_tokens, r.key, r.ended)
                     for r in token_counts.token_counts(spark, str(path), block_bytes=block).collect())
        assert got == [("a.bin", 0, 0, 2, None, True), ("a.bin", 1, 3, 0, None, True), ("a.bin", 2, 4, 1, None, True),
                       ("a.bin", 3, 6, 3, None, False), ("b.bin", 0, 0, 1, None, True)]


PAGE = ("<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li>menu</ul></nav>"
        "<div class=\"ad\">buy</div><article><h1>Head &amp; more</h1><p><b>Bold\n  text.<br><p>Second &lt;p&gt;</p>"
        "<div class='comments'><p>nice</p></div><form>mail <input></form><aside>side</aside><p>Last &#233;</article><footer>f</footer>")


def test_html_structure():
    assert html_extract.settled_text(PAGE) == "Head & more\nBold text.\nSecond <p>\nLast é"
    assert html_extract.settled_text("") == "" and html_extract.settled_text("<nav>x</nav>") == ""
    assert html_extract.settled_text("<p>open") is None
    assert html_extract.settled_text("<article><p>cut off <b>he") == "cut off he"


def test_html_names_do_not_hide_the_article(spark):
    article = "<article><div class='entry-header'><h1>Title</h1></div><p>Body</p><div class='post-comments'>nice</div></article>"
    for start in ("<body class='single no-sidebar'>", "<div class='page has-sidebar'>", "<div id=wrapper class='with-comments'>",
                  "<div class='nav-fixed'>", "<div class='menu'>", "<html class=widget><body class=search>"):
        assert html_extract.settled_text(f"{start}{article}<div class='related-posts'><article>teaser</article></div>" if "menu" not in start
                                         else start + article) == "Title\nBody"
    assert html_extract.sorted_blocks(f"<main><p>a</p><div class='promo'>{article}</div>") == [
        ("a", "judge"), ("Title", "keep"), ("Body", "keep"), ("nice", "outside")]
    assert {k for t, k in html_extract.sorted_blocks(f"<main><p>a</p><div class='side-bar'>b</div></main><ol class='comment-list'><li>{article}") if t != "a"} \
        == {"outside"}
    assert html_extract.settled_text(f"<article><p>a</p><div class='side-bar'>b</div></article><ol class='comment-list'><li>{article}") == "a"
    pages = spark.createDataFrame([(1, "http://n.example/", "<div class='page has-sidebar'><p>open text</p><div class='ad'>buy</div></div>"),
                                   (2, "http://n.example/2", "<div class='social'><p>all there is</p></div><footer>f</footer>")],
                                  "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {1: "open text", 2: "all there is"}


def test_html_host_suffix_array(spark):
    menu = "home news sports weather about contact imprint"
    own = lambda k: " ".join(f"only{k}say{j}" for j in range(9))
    pages = [(k, f"http://h.example/{k}", f"<div>{menu}</div><div>{own(k)}</div>") for k in range(8)]
    pages += [(50, "http://other.example/", f"<div>{menu}</div>"), (60, None, None), (61, "x", ""), (62, "http://h.example/a", PAGE), (None, "http://h.example/z", "<p>a"),
              (50, "http://other.example/", f"<div>{menu}</div>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, key int")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(pages) and all(r.n_chars == len(r.text) for r in got.collect())
    for k in range(8):
        assert found[k] == own(k)
    assert found[50] == menu and found[60] == "" and found[61] == "" and found[None] == "a"
    assert found[62] == "Head & more\nBold text.\nSecond <p>\nLast é"


def test_html_runs_count_over_the_whole_host(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 2)
    own = lambda k: " ".join(f"only{k}say{j}" for j in range(9))
    notice, phrase = "the office stays closed on all public holidays", "at the end of the day"
    long_ = " ".join(f"line{j}" for j in range(25))
    pages = []
    for k in range(24):
        page = f"<p>{own(k)}</p>"
        if k % 8 == 1:
            page += f"<p>{notice}</p><p>a{k} b{k} {phrase} c{k}</p><p>d{k} {long_} e{k}</p>"
        pages.append((k, f"http://big.example/{k}", page))
    pages += [(100, "http://big.example/x", f"<p>twice only here said again {own(100)}</p>")] * 4
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(24):
        assert got[k] == own(k) + (f"\na{k} b{k} {phrase} c{k}\nd{k} e{k}" if k % 8 == 1 else "")
    assert got[100] == f"twice only here said again {own(100)}"


def test_html_layout_in_main_is_told_by_the_host(spark):
    own = lambda k: " ".join(f"only{k}say{j}" for j in range(9))
    menu, share = "<div class=x1><ul><li>home<li>news<li>sports<li>weather today<li>contact us</ul></div>", "send this page to all your friends"
    pages = []
    for k in range(4):
        inner = f"<p>{own(k)}</p>"
        for j, (a, b) in enumerate((("<main>", "</main>"), ("<div class=main-content>", "</div>"), ("<main><article>", "</article></main>"))):
            pages.append((10 * k + j, f"http://m{j}.example/{k}", f"{a if j < 2 else '<main>'}{menu}{inner if j < 2 else '<article>' + inner}"
                          f"{'</article>' if j == 2 else ''}<div class=x2>{share}</div>{b if j < 2 else '</main>'}<footer>f</footer>"))
    pages += [(40 + k, f"http://a.example/{k}", f"<article><p>{share}</p><p>{own(k)}</p></article>") for k in range(4)]
    pages.append((50, "http://one.example/", f"<main>{menu}<p>{own(5)}</p></main>"))
    # Menu text outside the articles of other pages is evidence; repeats in their articles are not.
    pages += [(60, "http://e.example/", f"<main>{menu}<p>{own(6)}</p><p>{share}</p></main>")]
    pages += [(61 + k, f"http://e.example/{k}", f"<nav>{menu}</nav><article><p>{share}</p></article>") for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert [got[10 * k + j] for j in range(3)] == [own(k)] * 3
        assert got[40 + k] == f"{share}\n{own(k)}"
    assert got[50] == f"home\nnews\nsports\nweather today\ncontact us\n{own(5)}"
    assert got[60] == f"{own(6)}\n{share}" and got[61] == share


def test_html_articles_ask_their_host(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 2)
    own = lambda k: " ".join(f"only{k}say{j}" for j in range(30))
    menu = "<ul><li>home<li>news<li>sports<li>weather today<li>contact us</ul>"
    notice, quote = "this site keeps cookies to know you again", "to be or not to be that is"
    title, teaser, series = "how the town got its new bridge", "a bridge is built where the old one was", "letters to the editor of this week"
    page = lambda rows, rest, *apart: f"<article>{''.join(f'<p>{x}</p>' for x in rows)}{''.join(apart)}</article>{rest}"
    box = f"<div class=x2><p>{notice}</div>"
    pages, want = [], {}
    for k in range(9):  # a notice and a list of links in articles of nine pages, outside the articles of three
        outside = f"<nav>{menu}</nav><footer>{notice}</footer>" if k > 5 else "<footer>f</footer>"
        rows = [f"title of number {k}", own(k), quote, notice]  # what isn't set apart is the article's
        pages.append((k, f"http://ask.example/{k}", page(rows, outside, f"<div class=x1>{menu}</div>", box, f"<div>{quote}</div>")))
        want[k] = "\n".join([*rows, quote])
    # What only copies of one article have stays, also if a sidebar lists it; so do a title and a phrase in a sentence.
    listed = f"<aside>{title}</aside><aside>{teaser}</aside><aside>{series}</aside><footer>{notice}</footer>"
    for k in range(10, 14):
        rows = [own(10), f"{own(k).split(' ')[0]} says {notice} indeed"]
        pages.append((k, f"http://copy.example/?{k}", f"<article><p>town<div><h1>{title}</h1></div><section>{teaser}</section>{page(rows, listed)[9:]}"))
        want[k] = "\n".join(["town", title, teaser, *rows])
    for k in range(20, 23):
        pages.append((k, f"http://copy.example/{k}", f"<article><div><h1>{series}</h1></div>{page([own(k)], listed)[9:]}"))
        want[k] = f"{series}\n{own(k)}"
    # Two articles aren't enough; other hosts and repeated rows don't count; all there is of an article stays.
    for k in range(30, 34):
        pages.append((k, f"http://few{k // 32}.example/{k}", page([f"t{k}", own(k)], f"<footer>{notice}</footer>", box)))
        want[k] = f"t{k}\n{own(k)}\n{notice}"
    pages += pages[-4:] * 2
    pages.append((34, "http://ask.example/34", f"<article><div>{menu}</div>{box}</article>"))
    want[34] = "home\nnews\nsports\nweather today\ncontact us\n" + notice
    # An article in a page that the host has to tell as well.
    for k in range(40, 44):
        pages.append((k, f"http://open.example/{k}", f"<main><p>lead {own(50 + k)}</p>{page([f't{k}', own(k)], '', box)}</main><footer>{notice}</footer>"))
        want[k] = f"lead {own(50 + k)}\nt{k}\n{own(k)}"
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_covered_runs_need_distinct_pages():
    import numpy as np
    run = [1, 2, 3, 4, 5, 6]
    tokens = np.array([*run, *run, *run, -1, *run, 9, -2, 8, *run, -3])
    page = np.repeat([0, 1, 2], [19, 8, 8])
    got = html_extract.covered(tokens, page)
    assert got.tolist() == [True] * 18 + [False] + [True] * 6 + [False, False, False] + [True] * 6 + [False]
    assert not html_extract.covered(tokens[:27], page[:27]).any()


def test_empty_tables(empty, spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (exact_dedup.exact_copies(empty), exact_dedup.drop_copies(empty), quality.judge(empty), quality.keep_good(empty),
                 minhash.near_copies(empty), minhash.drop_near_copies(empty), mixing.mixed_slots(empty), mixing.mix(empty),
                 sentencepiece_bpe.encode_rows(empty, ["doc_id"]), suffix_dedup.removed_spans(empty), token_counts.document_tokens(empty),
                 line_dedup.remove_spread_lines(empty), pii_crf.personal_data(empty), html_extract.extract(pages)):
        assert made.collect() == []
