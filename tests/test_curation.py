import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import graph, pairs, quality, split, statistics


def frames(spark, singles, edges):
    bona_fide = spark.createDataFrame([(f"bf_{s}", s) for s in singles] or [], "image_id string, identity string")
    morphs = spark.createDataFrame([(f"m_{a}_{b}", a, b) for a, b in edges] or [], "image_id string, identity_a string, identity_b string")
    return bona_fide, morphs


def brute(vertices, edges):
    group = {v: v for v in vertices}
    for _ in vertices:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    return group


@pytest.mark.parametrize(
    ("singles", "edges"),
    [
        ("AB", []),
        ("AB", ["AB"]),
        ("ABC", ["AB", "BC"]),
        ("ABCDE", ["AB", "AC", "AD", "AE"]),
        ("ABC", ["AB", "BC", "CA", "AB", "BA"]),
        ("A", ["AA"]),
        ("", []),
    ],
)
def test_components(spark, singles, edges):
    got = split.components(*frames(spark, singles, edges)).collect()
    assert {r["identity"]: r["component"] for r in got} == brute(set(singles), [tuple(e) for e in edges])


def test_long_chain_and_random_graph(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert {r["vertex"]: r["component"] for r in got} == {v: c for v, c in brute(range(200), edges).items() if v in linked}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_contracted_edges_join_the_same_vertices(spark, kind):
    rng = random.Random(7)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(400)] + [(1, 1), (None, 2), (3, None), (2, 1), (1, 2)]
    rows = spark.createDataFrame(edges, "a long, b long").selectExpr(f"cast(a AS {kind}) AS a", f"cast(b AS {kind}) AS b")
    whole = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    cast = int if kind == "long" else str
    few = [(r["a"], r["b"]) for r in graph.contracted(rows.repartition(3)).collect()]
    assert len(few) <= len(whole) and all(a != b for a, b in few)
    names = {cast(v) for e in whole for v in e}
    assert brute(names, few) == brute(names, [(cast(a), cast(b)) for a, b in whole])
    assert graph.contracted(rows.limit(0)).count() == 0


def greedy(sizes, ratios):
    used, out = {"train": 0, "val": 0, "test": 0}, {}
    for name, n in sizes:
        best = min((s for s in used if ratios.of(s) > 0), key=lambda s: used[s] / ratios.of(s))
        out[name] = best
        used[best] += n
    return out


def test_greedy_fill_and_no_leaks(spark):
    rng = random.Random(1)
    singles = [f"id{i:03d}" for i in range(120)]
    edges = [(f"id{i:03d}", f"id{i + 1:03d}") for i in range(0, 100, 3)]
    for ratios in (split.SplitRatios(0.7, 0.2, 0.1), split.SplitRatios(1.0, 0.0, 0.0)):
        bona_fide, morphs = frames(spark, rng.sample(singles, 120), edges)
        assigned, placed = split.split_dataset(bona_fide, morphs, ratios)
        group = brute(singles, edges)
        sizes = sorted((c, sum(group[s] == c for s in singles) + sum(group[a] == c for a, _ in edges)) for c in set(group.values()))
        want = greedy(sizes, ratios)
        assert {r["identity"]: r["split"] for r in placed.collect()} == {s: want[group[s]] for s in singles}
        assert split.leaks(assigned, placed).count() == 0
        assert assigned.count() == 120 + len(edges)


def test_ratios_hold_in_blocks(spark):
    sizes = spark.range(1000).select(F.col("id").alias("component"), F.lit(1).cast("long").alias("images"))
    for rows in (50_000, 100):
        chosen = split.assign(sizes, split.SplitRatios(0.7, 0.2, 0.1), split.seeded_order(F.col("component"), 7), rows)
        share = {r["split"]: r["count"] / 1000 for r in chosen.groupBy("split").count().collect()}
        assert abs(share["train"] - 0.7) < 0.05 and abs(share["val"] - 0.2) < 0.05 and abs(share["test"] - 0.1) < 0.05


def test_blocks_are_one_sequence(spark):
    rng = random.Random(3)
    sizes = [(f"c{i:04d}", rng.randint(1, 9)) for i in range(700)] + [("c0300x", 1500)]
    ratios = split.SplitRatios()
    frame = spark.createDataFrame(sizes, "component string, images long")
    want = greedy(sorted(sizes), ratios)
    for rows in (50_000, 100):
        got = split.assign(frame, ratios, split.seeded_order(F.col("component"), None), rows)
        assert {r["component"]: r["split"] for r in got.collect()} == want


def test_ratio_checks():
    with pytest.raises(ValueError, match="negative"):
        split.SplitRatios(1.2, -0.1, -0.1)
    with pytest.raises(ValueError, match="sum to 1"):
        split.SplitRatios(0.5, 0.2, 0.2)
    assert split.shuffled(5, 3) == split.shuffled(5, 3)


ASSIGNED = [
    ("bf_a", "train", "bona_fide", ["A"]), ("bf_b", "train", "bona_fide", ["B"]), ("morph_ab", "train", "morph", ["A", "B"]),
    ("bf_c", "val", "bona_fide", ["C"]), ("bf_d", "test", "bona_fide", ["D"]), ("bf_e", "test", "bona_fide", ["E"]),
]
SCHEMA = "image_id string, split string, label string, identities array<string>"


def test_statistics(spark):
    got = {r["split"]: r for r in statistics.split_statistics(spark.createDataFrame(ASSIGNED, SCHEMA)).collect()}
    assert (got["overall"]["total_count"], got["overall"]["identity_count"], got["overall"]["morph_count"]) == (6, 5, 1)
    assert got["train"]["percentage_of_dataset"] == 50.0 and got["test"]["percentage_of_dataset"] == pytest.approx(100 / 3)
    assert got["train"]["class_balance"] == {"bona_fide": pytest.approx(2 / 3), "morph": pytest.approx(1 / 3)}
    empty = {r["split"]: r for r in statistics.split_statistics(spark.createDataFrame([], SCHEMA)).collect()}
    assert set(empty) == {"train", "val", "test", "overall"} and empty["val"]["percentage_of_dataset"] == 0.0


def found(issues):
    return {(r["check"], r["severity"]): r for r in issues.collect()}


def test_quality_checks(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    good = frame(ASSIGNED)
    assert quality.verify(good).count() == 0 and quality.verdict(quality.verify(good)).first()["passed"]
    leak = found(quality.verify(frame([*ASSIGNED, ("x", "test", "bona_fide", ["A"])])))
    assert set(leak) == {("identity_leakage", "error")}
    assert leak["identity_leakage", "error"]["context"] == {"identity": "A", "splits": "test,train"}
    assert leak["identity_leakage", "error"]["message"] == "Identity 'A' leaks across splits ['test', 'train']."
    assert set(found(quality.verify(frame([*ASSIGNED, ASSIGNED[3]])))) == {("duplicate_image", "error")}
    assert set(found(quality.verify(frame([*ASSIGNED, ("y", "val", "odd", ["F"])])))) == {("invalid_label", "error")}
    missing = found(quality.verify(frame([*ASSIGNED, ("z", "val", "morph", [])])))
    assert missing["missing_metadata", "error"]["context"]["missing_fields"] == "identities"
    members = spark.createDataFrame([("A", "A"), ("B", "A"), ("C", "A"), ("D", "D")], "identity string, component string")
    assert found(quality.verify(good, members))["component_leakage", "error"]["context"]["component"] == "A"
    expected = spark.createDataFrame([(r[0],) for r in ASSIGNED[:-1]] + [("new",)], "image_id string")
    assert quality.completeness(good, expected).count() == 2
    files = spark.createDataFrame([(r[0],) for r in ASSIGNED[1:]], "image_id string")
    assert [r["context"]["expected_path"] for r in quality.missing_files(good, files, "/i/").collect()] == ["/i/bf_a"]
    moved = good.withColumn("bucket", F.lit("train"))
    assert {r["check"] for r in quality.verify(moved).collect()} == {"csv_consistency"}


def test_inventory(spark):
    rows = [("r", "alice", "JPEG", 640, 480, i == 0) for i in range(10)] + [("r", "bob", "PNG", 1920, 1080, i < 1) for i in range(5)]
    images = spark.createDataFrame(rows, "dataset_root string, identity string, format string, width int, height int, corrupted boolean")
    folders = spark.createDataFrame([("r", "alice"), ("r", "bob"), ("r", "carol")], "dataset_root string, identity string")
    inventory = statistics.identity_inventory(images, folders)
    got = {r["identity"]: r for r in inventory.collect()}
    assert got["alice"]["image_count"] == 10 and got["alice"]["resolutions"] == ["640x480"] and got["carol"]["image_count"] == 0
    row = statistics.inventory_summary(inventory).first()
    assert (row["min_images"], row["max_images"], row["mean_images"], row["median_images"]) == (0, 10, 5.0, 5.0)
    assert statistics.inventory_summary(inventory.limit(0)).first()["mean_images"] == 0.0


def test_pairs(spark):
    people = spark.createDataFrame([("d", f"p{i}") for i in range(7)] + [("e", "q"), ("d", "p0"), ("d", None)], "g string, i string")
    every = sorted((f"p{a}", f"p{b}") for a in range(7) for b in range(a + 1, 7))
    assert sorted((r[1], r[2]) for r in pairs.unordered_pairs(people, "g", "i").collect()) == every
    for limit in (1, 5, 6, 7, 20, 21, 50):
        assert sorted((r[1], r[2]) for r in pairs.unordered_pairs(people, "g", "i", limit).collect()) == every[:limit]


def test_batches_cover_all_rows(spark):
    got = pairs.batches(spark.range(100), 32, F.xxhash64("id")).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in got) == [4, 32, 32, 32]
    assert pairs.batches(spark.range(100), 32, F.xxhash64("id"), drop_last=True).count() == 96


def test_batches_do_not_depend_on_buckets(spark):
    order = F.xxhash64("id")
    one, many = (sorted(map(tuple, pairs.batches(spark.range(300), 32, order, bucket_rows=n).collect())) for n in (10_000, 23))
    ranked = sorted(r["id"] for r in spark.range(300).orderBy(order).limit(32).collect())
    assert one == many and ranked == [i for i, batch in one if batch == 0]


def test_many_components_are_one_sequence(spark):
    """More components than one block holds, against the plain loop."""
    rng = random.Random(9)
    sizes = [(i, rng.randint(0, 7)) for i in range(60_000)]
    frame = spark.createDataFrame(sizes, "component long, images long").repartition(7)
    want = greedy(sizes, split.SplitRatios(0.7, 0.2, 0.1))
    for rows in (1_000_000, 25_000):
        got = split.assign(frame, split.SplitRatios(0.7, 0.2, 0.1), F.col("component"), rows)
        assert {r["component"]: r["split"] for r in got.collect()} == want


def test_exact_shuffle_refuses_large_sets(spark, monkeypatch):
    monkeypatch.setattr(split, "EXACT_ROWS", 3)
    sizes = spark.createDataFrame([(f"c{k}", 1) for k in range(4)], "component string, images long")
    assert split.shuffled_sizes(sizes.where("component < 'c3'"), 5).count() == 3
    with pytest.raises(ValueError, match="at most 3 components, not 4"):
        split.shuffled_sizes(sizes, 5)


def test_exact_shuffle(spark):
    people = [f"id{i:02d}" for i in range(30)]
    bona_fide, morphs = frames(spark, people, [("id00", "id07")])
    assigned, placed = split.split_dataset(bona_fide, morphs, split.SplitRatios(0.6, 0.2, 0.2), 5, exact=True)
    first = [p for p in people if p != "id07"]
    order = list(range(len(first)))
    random.Random(5).shuffle(order)
    want = greedy([(first[k], 3 if first[k] == "id00" else 1) for k in order], split.SplitRatios(0.6, 0.2, 0.2))
    assert {r["component"]: r["split"] for r in placed.collect()} == want
    assert split.check_disjoint(assigned, placed).count() == 31
    image = assigned.first()
    assert split.split_of(assigned, image["image_id"]) == image["split"]
    assert sorted(r[0] for r in split.component_of(placed, "id07").collect()) == ["id00", "id07"]
    for call in (lambda: split.split_of(assigned, "none"), lambda: split.component_of(placed, "none")):
        with pytest.raises(KeyError):
            call()
    moved = assigned.withColumn("split", F.when(F.col("image_id") == image["image_id"], "elsewhere").otherwise(F.col("split")))
    moved = moved.unionByName(assigned.where(F.col("image_id") == image["image_id"]))
    with pytest.raises(ValueError, match="several splits"):
        split.check_disjoint(moved, placed)
    counts = {r["split"]: r["component_count"] for r in statistics.component_counts(placed).collect()}
    assert counts["overall"] == 29 == counts["train"] + counts["val"] + counts["test"]


def test_duplicates_are_counted_by_split(spark):
    rows = [("a", "val", "morph", ["A"])] * 500 + [("a", "train", "morph", ["B"])] + [("b", "val", "morph", ["C"])]
    issues = quality.duplicate_images(spark.createDataFrame(rows, SCHEMA))
    row = issues.first()
    assert issues.count() == 1 and row["message"] == "Image 'a' appears 501 times across splits ['train', 'val']." and row["context"]["splits"] == "train:1,val:500"
    assert quality.issues_for(issues, "duplicate_image").count() == 1 and quality.issues_for(issues, "other").count() == 0


def test_scratch_is_released(spark, tmp_path):
    from loomwork import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Elsewhere)
    kept = session.materialise(spark.range(3), "x")
    assert kept.count() == 3 and session.run_dir(spark) in kept.inputFiles()[0]


def test_shared_stars_and_statistics_of_members(spark):
    edges = [(k, k + 1) for k in range(0, 300) if k % 10] + [(5, 299), (1000, 1000), (7, 7)] + [(k, 400 + k % 3) for k in range(500, 900)]
    rng = random.Random(4)
    rng.shuffle(edges)
    rows = spark.createDataFrame(edges, "a long, b long").repartition(9)
    want = {(r["vertex"], r["component"]) for r in graph.connected_components(rows).collect()}
    assert {(r["vertex"], r["component"]) for r in graph.components_of_pairs(rows).collect()} == want
    bona_fide, morphs = frames(spark, [f"p{k}" for k in range(40)], [(f"p{k}", f"p{k + 1}") for k in range(0, 30, 3)] + [("p0", "p9"), ("x", "x")])
    ratios = split.SplitRatios(0.7, 0.3, 0.0)
    slow = statistics.split_statistics(split.split_dataset(bona_fide, morphs, ratios)[0]).collect()
    assert sorted(statistics.member_statistics(split.split_members(bona_fide, morphs, ratios)).collect(), key=str) == sorted(slow, key=str)
