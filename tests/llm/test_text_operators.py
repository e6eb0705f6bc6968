"""Text operators against brute force over texts with nulls, empties, repeats, ties and long lines."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import compression_bands, line_dedup, mixing, packing, pii_crf, pii_spans, sequence_files, simhash, simhash_groups, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_lines string, _row int"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "délta", "EPSILON", "zeta.", "eta", "Θήτα", "x1", "#y|"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [None, "", " ", "\n", "\n\n", "one", words(rng, 25), "a\tb\x0bc\x0cd\re f", "nbsp here" + "\x1c", "Shared Line\nother", "x " * 3000, words(rng, 9000)]
    texts += ["  shared LINE \n" + words(rng, 40) for _ in range(12)]
    texts += ["call +1 (826) 555-4081 190.137.223.204 now", "mail a.b@mail1.example.com, or 4753376719988201 and 999.1.1.1", "@@x@y.z+1234567890 1.2.3.4.5 a@b.co_c@d.org"]
    base = words(rng, 300).split()
    texts += [" ".join(base), " ".join([*base[:150], "changed", *base[151:]]), " ".join(base)]
    out = [(i, t, rng.choice(["a", "b", "c", None, "A"]), "en", "clash", i) for i, t in enumerate(texts)]
    return [*out, out[6], out[6], (None, words(rng, 30), "a", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_quality_counts(docs, rows, none):
    got = compression_bands.judge(docs)
    assert set(SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")) <= set(got.columns)
    want = []
    for row in rows:
        text = row[1] or ""
        w, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = collections.Counter(runs)
        covered = {j for i, r in enumerate(runs) if often[r] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((row[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed))
    found = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(key, found)) == sorted(map(key, want))
    assert got.where("kept AND base_failed").count() == 0
    assert compression_bands.judge(none).count() == 0


def test_quality_bands():
    pack, bands = zstandard.ZstdCompressor(level=3), compression_bands.Bands()
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)).encode()
    assert compression_bands.within_bands(prose, bands, pack)[2]
    assert not compression_bands.within_bands(b"same words here again. " * 900, bands, pack)[2]
    assert not compression_bands.within_bands(rng.randbytes(20_000), bands, pack)[2]
    mixed = prose[:12_000] + b"x" * 12_000
    assert compression_bands.within_bands(mixed, bands, pack)[1] > 0.3
    assert not compression_bands.within_bands(mixed, bands, pack)[2]


def test_quality_bands_judge_the_rest():
    """What follows the last whole chunk counts by its bytes."""
    rng = random.Random(8)
    bands, pack = compression_bands.Bands(), zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)).encode()
    noise = base64.b64encode(rng.randbytes(9000))
    good, bad = prose[:4096], noise[:3900]
    assert compression_bands.within_bands(good + prose[4096:8000], bands, pack)[1:] == (0.0, True)
    ratio, share, kept = compression_bands.within_bands(good + bad, bands, pack)
    assert 1.4 <= ratio <= 4.0 and share == len(bad) / 7996 and not kept
    assert compression_bands.within_bands(good + noise[:1000], bands, pack)[1:] == (1000 / 5096, True)
    assert compression_bands.within_bands(prose[:900], bands, pack)[1:] == (0.0, True)


def test_line_dedup(docs, rows, none):
    def norm(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))

    seen = collections.defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            if norm(line):
                seen[norm(line)].add(row[0])
    want = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = [x for x in lines if len(seen.get(norm(x), ())) < 10]
        want.append((row[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_dropped"]
    assert sorted(map(key, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == sorted(map(key, want))
    assert got.agg(F.sum("n_dropped")).first()[0] == 13
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_without_an_id_are_one_document(spark):
    frame = spark.createDataFrame([(None, f"same\nown {k}") for k in range(30)] + [(7, "same\nmine")], "doc_id long, text string")
    assert line_dedup.dedup_lines(frame, min_docs=2).agg(F.sum("n_dropped")).first()[0] == 31
    assert line_dedup.dedup_lines(frame, min_docs=3).agg(F.sum("n_dropped")).first()[0] == 0


def test_lines_of_hot_and_rare_keys(spark):
    """Keys that are broadcast and keys that are joined by shuffle are found alike."""
    rng = random.Random(6)
    rows = [(d, 0, p, rng.choice([1, 1, 1, 2, 3, *range(4, 60)]), 9) for d in range(60) for p in range(20)]
    keys = spark.createDataFrame(rows, "_id long, _mark long, _pos int, h1 long, h2 long")
    frequent = line_dedup.frequent_keys(keys, 10)
    counted = collections.Counter(h for _, h in {(d, h) for d, _, _, h, _ in rows})
    want = sorted((d, m, p) for d, m, p, h, _ in rows if counted[h] >= 10)
    assert {r["h1"]: r["rows"] for r in frequent.collect()} == {h: n for h, n in collections.Counter(r[3] for r in rows).items() if counted[h] >= 10}
    for most in (1, 5, 10_000):
        assert sorted(map(tuple, line_dedup.lines_with(keys, frequent, most).collect())) == want


def test_simhash_and_components(docs, rows, none):
    import xxhash

    def mark(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            group[i] = min(group[j] for j in range(len(rows)) if (marks[i] ^ marks[j]).bit_count() <= 3)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = [(r[0], simhash._signed(m), least[g]) for r, m, g in zip(rows, marks, group, strict=True)]
    assert sorted(map(key, simhash.near_duplicates(docs).collect())) == sorted(map(key, want))
    assert simhash.near_duplicates(none).count() == 0


def test_masks_cover_every_difference():
    rng = random.Random(2)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(list(range(64)), radius)
        for _ in range(1000):
            change = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not change & m for m in masks)


def test_crowded_groups_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    values = sorted({centre ^ sum(1 << int(b) for b in rng.choice(20, size=rng.integers(0, 5), replace=False)) for _ in range(300)})
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")

    def parts(links):
        group = {simhash._signed(v): simhash._signed(v) for v in values}
        for _ in range(len(values)):
            before = dict(group)
            for a, b in links:
                group[a] = group[b] = min(group[a], group[b])
            if group == before:
                return group

    near = [(simhash._signed(a), simhash._signed(b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]
    for limit in (64, 2048):
        assert parts(simhash.near_links(frame, 3, group_rows=limit).collect()) == parts(near)


def test_similar_groups(spark, docs, none):
    rng = random.Random(9)
    texts = []
    for k in range(30):
        w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
        texts += [(4 * k, " ".join(w)), (4 * k + 1, " ".join([*w[:100], "edited", *w[101:]])), (4 * k + 2, " ".join(w)), (4 * k + 3, " ".join(rng.sample(w, 300)))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (2048, 16):
        got = dict(simhash_groups.similar_groups(frame, group_rows=limit).collect())
        assert all(got[i] == (i if i % 4 == 3 else i - i % 4) for i, _ in texts)
    kept = simhash_groups.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash_groups.keep_one(none).count() == 0
    one, other = texts[0][1], texts[4][1]
    clash = spark.createDataFrame([(5, one), (7, one), (3, other), (5, other)], "doc_id long, text string")
    assert sorted(simhash_groups.keep_one(clash).collect()) == [(3, other), (5, one)]


def test_minhash_bands_meet_similar_sets():
    """Sets of similarity 0.8 share a key but for about 4 in 10,000; unrelated ones share none."""
    rng, tables, missed = np.random.default_rng(3), simhash_groups.Tables(), 0
    for _ in range(1500):
        hashes = rng.integers(0, 2**63, 220, dtype=np.uint64)
        a, b = (set(tables.keys(np.sort(h)).tolist()) for h in (hashes[:198], hashes[22:]))  # 176 of 220 in common
        missed += not a & b
        assert not a & set(tables.keys(rng.integers(0, 2**63, 200, dtype=np.uint64)).tolist())
    assert missed <= 5


def test_similar_groups_are_exact(spark):
    """Groups around the threshold are those of brute force over shingle sets, repeated shingles and short texts included."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice((4, 6, 12, 40, 200)))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(max(1, round(len(base) * rng.uniform(0.005, 0.035)))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(5):
        base = [word() for _ in range(60)]
        texts += [" ".join([*base, *["-----"] * 8]), " ".join([*base, *["-----"] * 60])]
    base = [word() for _ in range(100)]
    texts += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 100, 4)]
    sets = [set(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    want = list(range(len(texts)))
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            share = common / (len(sets[i]) + len(sets[j]) - common)
            near += 0.7 < share < 0.9
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert near > 40 and len(set(want)) > 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (2048, 16):
        assert [g for _, g in sorted(simhash_groups.similar_groups(frame, group_rows=limit).collect())] == want


def test_a_hub_meets_its_copies_in_parts(spark, monkeypatch):
    """600 near copies of one long text, and texts that only share half of it: one group and single ones, whatever the parts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(500)]
    texts = [" ".join(base)]
    for _ in range(600):
        copy = list(base)
        copy[rng.randrange(500)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([*base[:250], *[word() for _ in range(250)]]) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [0] * 601 + list(range(601, 621))
    for size in (20_000, simhash_groups.PART_BYTES):  # five texts a part, and one part
        monkeypatch.setattr(simhash_groups, "PART_BYTES", size)
        assert [g for _, g in sorted(simhash_groups.similar_groups(frame).collect())] == want


def test_token_counts(docs, rows, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = []
    for row in rows:
        text = row[1] or ""
        n = len(sp.encode(text))
        want.append((row[0], len(text.encode()), n, n > 100))
    for size, held in ((24 << 20, 500_000), (500, 500_000), (2_000, 1)):
        got = token_counts.count_tokens(docs, model, limit=100, block_bytes=size, part_tokens=held).collect()
        assert sorted(map(key, got)) == sorted(map(key, want))
    assert token_counts.count_tokens(none, model).count() == 0


def test_pre_tokens_are_exact():
    model = public_tokenizers.path("piece_bpe_32k.model")
    counter, rng = token_counts.PieceCounter(model), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b ", " ", "  ", "\n", "\t", ".", "▁", "é", "the", "<s>", "</s>", "\0", "漢", "🙂", "1"]) for _ in range(rng.randint(0, 12)))
        assert sum(counter(token_counts.pre_tokens(text))) == len(counter.model.encode(text))


def test_sequence_files(spark, docs, rows, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    known = [r for r in rows if r[0] is not None]
    for shards, length in ((1, 16), (3, 64)):
        frame = docs.where("doc_id IS NOT NULL")
        written = sequence_files.write_sequences(frame, path, f"file://{tmp_path}/{shards}", length=length, shards=shards)
        got = sorted(sequence_files.read_documents(written).collect())
        at = 0
        for row, (doc, start, n, crc) in zip(sorted(known, key=lambda r: (r[0], r[1] or "")), got, strict=True):
            ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
            assert (doc, start, n, crc) == (row[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += n
    reader = sequence_files.ShardReader(written.orderBy("shard").first()["path"])
    flat = np.concatenate([ids for _, ids in reader.documents()])
    ids, mask = reader.sequence(1)
    assert (ids == flat[64:128]).all() and reader.real(mask).all()
    assert sequence_files.read_documents(sequence_files.write_sequences(none, path, f"file://{tmp_path}/none")).count() == 0
    assert sequence_files.write_sequences(docs, path, f"file://{tmp_path}/null", shards=2).agg(F.sum("n_docs")).first()[0] == len(rows)


def test_rows_without_ids_spread_over_shards(spark, tmp_path):
    texts = sorted(f"{k % 97:02d} word {k}" for k in range(2000))
    frame = spark.createDataFrame([(None, t) for t in texts[::-1]], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    written = sequence_files.write_sequences(frame, path, f"file://{tmp_path}/out", shards=8)
    counts = [r["n_docs"] for r in written.collect()]
    assert sum(counts) == 2000 and len(counts) > 4 and max(counts) < 700
    want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert [r["n_tokens"] for r in sequence_files.read_documents(written).orderBy("start").collect()] == want


def test_sequences_by_number(tmp_path):
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 40, 500)
    flat = rng.integers(0, 60_000, counts.sum()).astype("<u2")
    writer = sequence_files.ShardWriter(f"file://{tmp_path}/one.arrow", 8, "uint16", batch_rows=16)
    for a, b in ((0, 3), (3, 3), (3, 450), (450, 500)):
        before = counts[:a].sum()
        writer.add(pa.array(range(a, b), pa.int64()), flat[before : counts[:b].sum()], counts[a:b])
    writer.close()
    reader = sequence_files.ShardReader(f"file://{tmp_path}/one.arrow")
    rows = -(-len(flat) // 8)
    sizes = [batch.num_rows for batch in reader.batches()]
    assert sum(sizes) == rows and set(sizes[:-1]) == {16}
    for k in range(rows):
        ids, mask = reader.sequence(k)
        n = int(reader.real(mask).sum())
        assert (ids[:n] == flat[8 * k : 8 * k + n]).all() and n == min(8, len(flat) - 8 * k) and not ids[n:].any() and not reader.real(mask)[n:].any()
        assert not ids.flags.owndata and not mask.flags.owndata and not mask.flags.writeable  # views of the mapped file
    assert [d for d, _ in reader.documents()] == list(range(500))
    for k in (-1, rows):
        with pytest.raises(IndexError):
            reader.sequence(k)


def test_text_slices_hold_all_rows():
    texts = ["a" * n for n in (0, 3, 50, 1, 1, 0, 9)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    for most in (1, 4, 1000):
        assert [r for s in sequence_files.text_slices(batch, 1, most) for r in s.column(0).to_pylist()] == list(range(len(texts)))


def test_word_encoder_is_exact():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encode, rng = Tokenizer.from_file(path), sequence_files.WordEncoder(path, "uint16", 300), random.Random(3)
    pieces = ["a", "B", "É", "ß", "İ", "Σ", "ς", " ", "\n", ".", ",", "'s", "'", "<|endoftext|>", "<|", "é", "1", "½", "漢", "ᄀ", "ᅡ", "_", "#", "क़", "µ", "į", "ª", "\u0301"]
    for _ in range(60):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 10))) for _ in range(60)] + [None]
        ids, counts = encode(pa.array(texts, pa.string()))
        made = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(m) for m in made] and ids.tolist() == [i for m in made for i in m]
    assert [len(x) for x in encode(pa.array([], pa.string()))] == [0, 0]


def _water(sizes, weights, total, ceiling):
    got, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = total
    while open_:
        share = {s: rest * weights[s] / sum(weights[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= ceiling * sizes[s]}
        if not full:
            return got | share
        for s in full:
            got[s] = ceiling * sizes[s]
        rest -= sum(got[s] for s in full)
        open_ -= full
    return got


def test_mixing(spark, docs, none):
    rng = random.Random(8)
    sources = ["hot"] * 700 + ["b"] * 100 + ["c"] * 60 + [None] * 30 + ["z"] * 5
    data = [(i, s, rng.choice([0, 1, 5, 50, 300]), rng.choice([None, 0.5, 2.0])) for i, s in enumerate(sources)]
    data += [data[3], (None, "b", 7, None), (2000, "empty", 0, None), (2001, "b", None, 1.0)]
    frame = spark.createDataFrame(data, "doc_id long, source string, size long, quality double")
    one, many = (mixing.mix_sources(frame, quality_col="quality", bucket_rows=n) for n in (10**6, 37))
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    sizes = collections.Counter()
    for _, s, n, _q in data:
        sizes[s] += n or 0
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = _water(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    taken, largest = collections.Counter(), 300
    for row in one.collect():
        assert row["target"] == pytest.approx(target[row["source"]])
        assert row["source_size"] == sizes[row["source"]] and 0 <= row["copies"] <= 2
        taken[row["source"]] += row["copies"] * (row["size"] or 0)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1e-6 for s in sizes)
    good = one.where("source = 'hot' AND size > 0").groupBy("quality").agg(F.avg(F.col("copies") - F.col("epochs")).alias("m")).collect()
    share = {r["quality"]: r["m"] for r in good}
    assert share[2.0] > share[0.5]
    low = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).alias("size"), F.element_at(F.array(F.lit(1e-6), F.lit(0.01), F.lit(9.0)), (F.col("id") % 3 + 1).cast("int")).alias("q"))
    whole, cut = (mixing.mix_sources(low, quality_col="q", bucket_rows=n) for n in (10**6, 50))
    assert sorted(whole.collect()) == sorted(cut.collect())
    assert mixing.mix_sources(none.withColumn("size", F.lit(1))).count() == 0
    assert mixing.mix_sources(docs.withColumn("size", F.length("text"))).count() == docs.count()


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(6)
    for _ in range(60):
        lengths = np.array(rng.sample(range(0, 60), rng.randint(1, 9)))
        counts = np.array([rng.randint(1, 20) for _ in lengths])
        for k in (1, 2, 3, 4):
            ends = packing.optimal_boundaries(lengths, counts, k)

            def cost(ends):
                return sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True))

            best = min(cost(e) for m in range(1, k + 1) for e in itertools.combinations(sorted(lengths), m) if max(e) == max(lengths))
            assert len(ends) <= k and cost(ends) == best
    assert packing.optimal_boundaries(np.array([]), np.array([]), 4) == []


def test_packing(spark, none):
    rng = random.Random(7)
    data = [(i, rng.choice([0, 3, 40, 100, 257, 900, None])) for i in range(400)] + [(5, 3), (5, 3), (None, 10)]
    frame = spark.createDataFrame(data, "doc_id long, n_tokens long")
    got = packing.pack(frame, max_len=100, buckets=4, batch_tokens=512, block_rows=50).collect()
    assert sum(r["n_tokens"] for r in got) == sum(n or 0 for _, n in data)
    assert len(got) == sum(max(1, -(-(n or 0) // 100)) for _, n in data)
    slots = [(r["bucket"], r["batch_id"], r["slot"]) for r in got]
    assert len(set(slots)) == len(slots)
    assert len({r["bucket"] for r in got}) <= 4
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"] <= 100 and r["slot"] < r["batch_size"]
        assert r["batch_size"] * r["bucket_len"] <= 512 or r["batch_size"] == 1
    for bucket in {r["bucket"] for r in got}:
        mine = [r for r in got if r["bucket"] == bucket]
        assert max(r["batch_id"] for r in mine) == (len(mine) - 1) // mine[0]["batch_size"]
    assert packing.pack(none.withColumn("n_tokens", F.lit(1))).count() == 0


def test_packing_spreads_one_id(spark):
    frame = spark.createDataFrame([(None if k % 2 else 7, 5 + k % 3) for k in range(400)], "doc_id long, n_tokens long")
    got = packing.pack(frame, buckets=2, batch_tokens=70, block_rows=20).collect()
    assert len(got) == 400 and sum(r["n_tokens"] for r in got) == sum(5 + k % 3 for k in range(400))
    for bucket in {r["bucket"] for r in got}:
        mine = sorted((r["batch_id"], r["slot"]) for r in got if r["bucket"] == bucket)
        size = next(r["batch_size"] for r in got if r["bucket"] == bucket)
        assert mine == [divmod(k, size) for k in range(len(mine))]


def test_mixing_without_ids_agrees(spark):
    rows = [(None, "a" if k % 3 else "b", 10 + k % 7, f"text {k}") for k in range(300)] + [(5, "a", 9, f"twice {k}") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, text string")
    runs = [sorted(mixing.mix_sources(frame.repartition(n), bucket_rows=30).select("text", "copies").collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 340


def test_mixing_equal_rows(spark):
    """Of equal rows as many get a copy more as the budget holds."""
    frame = spark.createDataFrame([(1, "a", 10)] * 50 + [(None, "b", 3)] * 40, "doc_id long, source string, size long")
    got = mixing.mix_sources(frame)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "epochs", "copies"] and got.count() == 90
    for source, n in (("a", 50), ("b", 40)):
        mine = [r for r in got.collect() if r["source"] == source]
        assert len(mine) == n and abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= mine[0]["size"] / 2


def test_base_spans():
    rng = random.Random(10)
    patterns = [
        re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"),
        re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    checks = [
        lambda s: True,
        lambda s: all(int(p) <= 255 for p in s.split(".")),
        pii_spans.is_card,
        lambda s: 9 <= sum(c.isdigit() for c in s) <= 15,
    ]
    pieces = ["a", "b.c", "@", "x@y.z", ".", "_", "-", " ", "+", "1", "25", "255", "4111111111111111", "(555)", "+1 ", "é", "%", "1.2.3.4", "\n", "00"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = sorted(((m.start(), m.end(), k) for k, p in enumerate(patterns) for m in p.finditer(text) if checks[k](m.group())), key=lambda s: (s[0], s[2]))
        assert pii_spans.base_spans(text)[0] == want, text
    long = "1" * 200_000 + "a" * 200_000 + "@"
    assert pii_spans.base_spans(long)[0] == []


def test_crf(spark, docs, rows, none):
    held = [x for x in pii_crf.made_up(300, 77) if len(x[0])]
    field = pii_crf.train(docs, made=800)
    graph, truth = pii_crf.joined([g for g, _ in held]), np.concatenate([y for _, y in held])
    marginals = field.infer(graph)[0]
    sure = marginals.max(axis=1) >= 0.9
    right = marginals.argmax(axis=1) == truth
    assert right[sure & (marginals.argmax(axis=1) > 0)].mean() > 0.97
    assert (sure & right & (truth > 0)).sum() > 0.75 * (truth > 0).sum()
    got = {r["doc_id"]: r for r in pii_crf.find_spans(docs, field).collect()}
    for row in rows:
        base = [s for s, a in zip(zip(got[row[0]]["starts"], got[row[0]]["ends"], got[row[0]]["kinds"], strict=True), got[row[0]]["added"], strict=True) if not a]
        if row[0] is not None:
            assert base == pii_spans.base_spans(row[1] or "")[0]
    call = next(r for r in rows if r[1] and r[1].startswith("call"))
    assert [call[1][s:e] for s, e, a in zip(got[call[0]]["starts"], got[call[0]]["ends"], got[call[0]]["added"], strict=True) if a] == ["+1 (826) 555-4081"]
    assert pii_crf.find_spans(none, field).count() == 0


def test_skip_edges_carry_labels():
    text = "reach +1 (826) 555-4081 today, " + "so " * 50 + "again 555-4081"
    graph = pii_crf.build_graph(text)
    assert graph.skip.tolist() == [[2, 3]]
    weights = pii_crf.Field(np.zeros((pii_crf.WIDTH, 6)), np.zeros((6, 6)), 3 * np.eye(6))
    weights.node[0, 4] = 0.1
    first = weights.infer(graph)[0]
    assert first[2, 4] > first[0, 4]


def exact_marginals(field, graph):
    """By all labellings of a small graph."""
    n, total = len(graph), 0.0
    out = np.zeros((n, pii_crf.LABELS))
    unary = graph.features @ field.node
    for labels in itertools.product(range(pii_crf.LABELS), repeat=n):
        weight = sum(unary[i, y] for i, y in enumerate(labels))
        weight += sum(field.chain[labels[a], labels[b]] for a, b in graph.chain) + sum(field.skip[labels[a], labels[b]] for a, b in graph.skip)
        total += np.exp(weight)
        for i, y in enumerate(labels):
            out[i, y] += np.exp(weight)
    return out / total


def test_messages_equal_enumeration():
    """On trees sum-product is exact; with a loop it stays near."""
    rng = np.random.default_rng(4)
    skip = rng.normal(size=(6, 6))
    field = pii_crf.Field(rng.normal(size=(pii_crf.WIDTH, 6)) * 0.7, rng.normal(size=(6, 6)), (skip + skip.T) / 2)
    features = rng.integers(0, 2, (5, pii_crf.WIDTH)).astype(np.uint8)
    for chain, skips, gap in (([(0, 1), (1, 2)], [(0, 3), (3, 4)], 0.003), ([(0, 1)], [(1, 4), (2, 4), (3, 4)], 0.003), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.15)):
        graph = pii_crf.Graph([(0, 0)] * 5, features, np.array(chain), np.array(skips))
        assert np.abs(field.infer(graph, rounds=60)[0] - exact_marginals(field, graph)).max() < gap


def test_repeats_in_other_forms_hang_on_skip_edges(field):
    """Repeats that tell nothing alone are found beside a sure copy, and are lost without skip potentials; lone look-alikes stay."""
    rng = random.Random(31)
    number, filler = lambda n: "".join(rng.choice("0123456789") for _ in range(n)), "so we walked on and "
    texts, want = [], []
    for k in range(60):
        a, b, c = rng.choice("23456789") + number(2), rng.choice("23456789") + number(2), number(4)
        value = "".join(rng.choice("ABCDEFGHKLMNPQRST0123456789") for _ in range(18)) + "A7"
        first, again = ((f"reach +1 ({a}) {b}-{c} today", f"{a} {b} {c}"), (f"ring +1 {a} {b} {c} or", f"{a}{b}{c}"), (f"secret: {value} is set", value))[k % 3]
        texts.append(f"{first} {filler * rng.randint(2, 40)}{again} at last")
        want.append((len(texts[-1]) - len(" at last") - len(again), len(texts[-1]) - len(" at last"), 4 if k % 3 == 2 else 3))
    lone = [f"lot {number(3)} {number(3)} {number(4)} of {filler}" for _ in range(40)] + [f"{filler}part {number(10)} fits" for _ in range(20)]
    lone += ["seats " + "".join(rng.choice("ABCDEFGHKLMNPQRST0123456789") for _ in range(20)) + " there" for _ in range(20)]
    caught = lambda f: sum(span in added for (_, added), span in zip(pii_crf.marked_spans(texts, f, 0.9, 16_384), want, strict=True))
    assert caught(field) >= 0.9 * len(texts)
    assert caught(pii_crf.Field(field.node, field.chain, np.zeros((6, 6)))) <= 0.3 * len(texts)
    assert sum(bool(added) for _, added in pii_crf.marked_spans(lone, field, 0.9, 16_384)) <= 2


def test_similar_tokens_are_joined():
    graph = pii_crf.build_graph("call +1 (212) 555-1234 or later 212 555 1234 and key=AbCd1234efgh5678ij then abcd1234efgh5678ij or abcd1234efgh5678zz")
    token = {text: i for i, text in enumerate(["+1", "(212)", "555-1234", "212", "555", "1234", "key=", "value", "cut"])}
    edges = {tuple(e) for e in graph.skip.tolist()}
    assert edges == {(token["(212)"], token["212"]), (token["555-1234"], token["1234"]), (token["key="], token["value"]), (token["value"], token["cut"])}


def test_neighbouring_numbers_and_repeats(spark, docs):
    """Adjacent numbers are spans of their own, also one per line, and the seven digits of a known phone are one."""
    field = pii_crf.train(docs, made=800)
    cases = {
        "212-555-1234 212-555-9876": ["212-555-1234", "212-555-9876"],
        "ring 212-555-1234\n212-555-9876\n212-555-4477\nnow": ["212-555-1234", "212-555-9876", "212-555-4477"],
        "reach +1 (826) 555-4081 today, " + "so " * 50 + "again 555-4081": ["+1 (826) 555-4081", "555-4081"],
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for row, (text, want) in zip(sorted(pii_crf.find_spans(frame, field).collect()), cases.items(), strict=True):
        assert [text[a:b] for a, b, k in zip(row["starts"], row["ends"], row["kinds"], strict=True) if k == 3] == want
    graph = pii_crf.build_graph("4111111111111111 5500005555555559 now")
    marginals = np.tile(np.eye(6)[3], (len(graph), 1))
    assert pii_crf.added_spans("4111111111111111 5500005555555559 now", graph, marginals, [], 0.9) == [(0, 16, 2), (17, 33, 2)]


@pytest.fixture(scope="module")
def field(docs):
    return pii_crf.train(docs, made=1_500)


def test_secrets(spark, field):
    """Values behind words that announce them, and their repeats; digests, serials and versions are left alone."""
    value, other = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "a1c3e5f7b9d1a3c5e7f9b1d3a5c7e9f1b3d5a7c9"
    cases = {
        f'the token = "{value}" here and': [value],
        f"password=hunter2hunter22xq and so on": ["hunter2hunter22xq"],
        f"token: {value} first, " + "then more words " * 40 + f"and {value} at the end": [value, value],
        f"commit {other} fixes it": [],
        "version 1.2.3 of 2024-01-05 at 10:31, page 12": [],
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for row, (text, want) in zip(sorted(pii_crf.find_spans(frame, field).collect()), cases.items(), strict=True):
        assert [text[a:b] for a, b, k in zip(row["starts"], row["ends"], row["kinds"], strict=True) if k == pii_crf.SECRET] == want, text


def test_marginals_do_not_depend_on_neighbours(field):
    texts = [pii_crf.build_graph(t) for t in ('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and again 9b0b3c6a43eb78aa99cbd7049c572391524f37a8', "call 212-555-1234 212-555-9876 or 555-9876 now", "id 12345678 and 12345678 " * 9)]
    joint = field.infer(pii_crf.joined(texts), owner=np.repeat(np.arange(3), [len(g) for g in texts]))[0]
    alone = np.concatenate([field.infer(g)[0] for g in texts])
    assert np.abs(joint - alone).max() < 1e-12


def test_long_texts_take_linear_time(field):
    text = " ".join(f"user{k}@mail{k % 7}.example.com" for k in range(100_000)) + ' token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"'
    began = time.process_time()
    (base, added), (short, _) = pii_crf.marked_spans([text, "a 10.0.0.1 b"], field, 0.9, 16_384)
    assert len(base) == 100_000 and len(added) == 1 and short == [(2, 10, 1)]
    assert time.process_time() - began < 60


def test_pii_query(spark, rows, tmp_path):
    """The query's counts and digests, formed again from patterns alone."""
    texts = [(k, r[1]) for k, r in enumerate(rows)] + [(900, "a.b@c.de 10.1.2.3, +1 (826) 555-4081 or 4111 1111 1111 1111"), (900, 'é token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"'), (None, "+49 30 1234567 x@y.z")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in texts:
        found = pii_spans.base_spans(text or "")[0]
        names = [f"{pii_spans.KINDS[k]}:{a}:{b}" for a, b, k in found]
        counts = collections.Counter(k for _, _, k in found)
        want.append((doc, *(counts[k] for k in range(4)), hashlib.sha256(",".join(names).encode()).hexdigest(), names))
    got = pii_crf.query(spark, str(tmp_path)).collect()
    base = lambda r: [s for s in r["spans"].split(",") if s]
    assert sorted((key(r[:6]) for r in got)) == sorted(key(w[:6]) for w in want)
    for r in got:
        spans = [(int(s.split(":")[1]), pii_crf.SPAN_KINDS.index(s.split(":")[0])) for s in base(r)]
        assert spans == sorted(spans) and len(spans) == r["n_spans"] == r["n_added"] + sum(r[1:5]) and r["flagged"] == bool(spans)
        assert r["n_secret"] == sum(s.startswith("secret:") for s in base(r))
        assert any((w[0], w[5]) == (r["doc_id"], r["base_sha256"]) and set(w[6]) <= set(base(r)) for w in want)
    assert sum(r["n_secret"] for r in got) >= 1


def test_quality_query(spark, tmp_path):
    """Counts and verdicts of the query, each formed again in plain loops."""
    rng = random.Random(15)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    noise = base64.b64encode(bytes(rng.randrange(256) for _ in range(6000))).decode()
    texts = [prose(n) for n in (10, 25, 200, 900, 4000)] + [prose(700) + "\n" + noise, " ".join([noise[k : k + 40] for k in range(0, 4000, 40)]), ("same words again " * 8 + "\n") * 40, prose(60) + "\na\na\n \n \nb#*$", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pack = zstandard.ZstdCompressor(level=3)
    whole = [(10_000, 1.5, 5.0), (1_000, 1.4, 4.0), (300, 1.2, 3.5), (100, 0.85, 3.0), (0, 0.0, float("inf"))]
    got = {r["doc_id"]: r for r in compression_bands.query(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        text, r = text or "", got[k]
        tokens = WORD.findall(text)
        windows = collections.Counter(tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7))
        repeated = {j for i in range(len(tokens) - 7) if windows[tuple(tokens[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, again = set(), 0
        for line in text.split("\n"):
            again += bool(WORD.search(line)) and line in seen
            seen.add(line)
        failed = len(tokens) < 20 or 100 * len(repeated) > 30 * len(tokens)
        data, bad = text.encode(), 0
        fits = lambda b, low, high: low <= len(b) / len(pack.compress(b)) <= high
        band = lambda n: next(x[1:] for x in whole if n >= x[0])
        for at in range(0, len(data), 4096):
            chunk = data[at : at + 4096]
            bad += 0 if fits(chunk, *((1.4, 6.0) if len(chunk) == 4096 else band(len(chunk)))) else len(chunk)
        kept = not failed and fits(data, *band(len(data))) and bad <= 0.3 * len(data)
        want = (len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), failed, kept)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == want, k
    assert {r["kept"] for r in got.values()} == {True, False} and {k for k, r in got.items() if not r["base_failed"] and not r["kept"]}


def test_simhash_query(spark, tmp_path):
    texts = ["one two three four five", "One TWO three four five", "one two", "", None, "quite another text altogether here"]
    spark.createDataFrame([(10 + k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        words = [w.lower() for w in WORD.findall(text or "")]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert got[10 + k][0] == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"
    assert got[10] == got[11] and got[13] == ("0" * 16, 13) and got[14] == ("0" * 16, 13)


def test_packing_of_one_hot_id_keeps_the_order(spark):
    """A block that one missing id fills is numbered over many tasks, in the same order as a small one, in each run."""
    rows = [(None, k % 7) for k in range(400)] + [(k, 3 + k % 9) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = [sorted(map(tuple, packing.pack(d, buckets=1, batch_tokens=64, block_rows=10).collect()), key=str) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("n_tokens")))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 460
    blocks = 46
    mark = lambda i: int(hashlib.md5(f"17:{'null' if i is None else i}:0".encode()).hexdigest()[:15], 16)
    want = sorted(rows, key=lambda r: (mark(r[0]) % blocks, mark(r[0]), r[0] is not None, r[0] or 0, r[1]))
    size = got[0][0][8]
    assert [(r[0], r[3]) for r in sorted(got[0], key=lambda r: (r[6], r[7]))] == want and {r[6] * size + r[7] for r in got[0]} == set(range(460))
