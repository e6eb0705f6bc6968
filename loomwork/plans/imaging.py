"""Image queries: each embedding is an 8 x 8 image, its components scaled to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.functions import chain, kernels, pixels, warps
from loomwork.operators import faces, model, morphs
from loomwork.plans.evaluation import rounded
from loomwork.session import spread


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, p): 64 bytes of each embedding."""
    byte = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.5) * 255.0), F.lit(0)), F.lit(255)).cast("int")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", byte).alias("p"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images in three equal channels, as bytes."""
    return coloured(gray(spark, sf_dir))


def coloured(known: DataFrame, *more: str) -> DataFrame:
    """known(vec_id, p) as images of three equal channels, and more of its columns."""
    colour = F.flatten(F.transform("p", lambda p: F.array(p, p, p)))
    return known.select(F.concat(F.lit("img/"), "vec_id").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.packed(colour).alias("data"), *more)


GRAY = "g AS (SELECT vec_id, [least(greatest(floor((x::DOUBLE + 0.5::DOUBLE) * 255), 0), 255)::INT for x in embedding] AS p FROM embeddings)"


def point_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flip, brightness, both contrasts and gamma, as text."""
    p, text = F.col("p"), lambda c: F.array_join(c.cast("array<string>"), " ")
    ready = gray(spark, sf_dir).withColumn("mean", pixels.mean(p)).withColumn("whole", F.rint("mean"))
    return ready.select(
        "vec_id",
        text(pixels.flipped(p, 8)).alias("flipped"),
        text(pixels.brightened(p, 1.3)).alias("brightened"),
        text(pixels.contrasted(p, 1.3, F.col("mean"))).alias("contrasted"),
        text(pixels.contrasted_rounded(p, 1.3, F.col("whole"))).alias("contrasted_rounded"),
        text(pixels.gamma_corrected(p, 1.5)).alias("gamma"),
        text(pixels.resized_nearest(p, 8, 8, 4, 4)).alias("resized"),
    )


def text(c) -> Column:
    return F.array_join(c.cast("array<string>"), " ")


def parameter(modulus: int, first: float, step: float) -> Column:
    """A number for each image: first + step * (vec_id % modulus)."""
    return F.lit(first) + F.lit(step) * (F.col("vec_id") % modulus)


def warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image turned, moved, enlarged and reduced by numbers of its own."""
    p = F.col("p")
    return gray(spark, sf_dir).select(
        "vec_id",
        text(warps.rotated(p, 8, 8, parameter(31, -15.0, 1.0))).alias("rotated"),
        text(warps.shifted(p, 8, 8, parameter(21, -0.1, 0.01), parameter(19, -0.09, 0.01))).alias("shifted"),
        text(warps.enlarged(p, 8, 8, parameter(5, 1.0, 0.05))).alias("enlarged"),
        text(warps.reduced(p, 8, 8, parameter(5, 0.7, 0.05))).alias("reduced"),
    )


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image blurred by a fixed and by a computed kernel, along a motion, and sharpened."""
    p = F.col("p")
    return gray(spark, sf_dir).select(
        "vec_id",
        text(warps.blurred(p, 8, 8, kernels.gaussian_line(5, 0.0))).alias("blurred"),
        text(warps.blurred(p, 8, 8, kernels.gaussian_line(9, 1.3))).alias("blurred_wide"),
        text(warps.smeared(p, 8, 8, kernels.motion(5, 30.0))).alias("smeared"),
        text(warps.sharpened(p, 8, 8, parameter(4, 0.5, 0.5), kernels.gaussian_line(19, 3.0))).alias("sharpened"),
    )


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with normal noise and with specks, both drawn by image and place."""
    p, key = F.col("p"), F.col("vec_id")
    return gray(spark, sf_dir).select(
        "vec_id", text(warps.noisy(p, key, parameter(14, 2.0, 1.0), seed=3)).alias("noisy"), text(warps.speckled(p, key, parameter(5, 0.01, 0.01), seed=5)).alias("speckled")
    )


def recompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image through cosine blocks quantised at a quality of its own."""
    quality = F.lit(30) + F.col("vec_id") % 61
    return gray(spark, sf_dir).select("vec_id", text(warps.recompressed(F.col("p"), 8, 8, quality, kernels.LUMINANCE, kernels.CHROMINANCE)).alias("recompressed"))


def _cosine_sum(weights: str, source: str) -> str:
    return f"[list_sum([{weights} * {source}[k + 1] for k in range(64)]) for f in range(64)]"


def _mirror(at: str, size: str = "8") -> str:
    return f"least((({at}) % (2 * {size} - 2) + 2 * {size} - 2) % (2 * {size} - 2), 2 * {size} - 2 - (({at}) % (2 * {size} - 2) + 2 * {size} - 2) % (2 * {size} - 2))::INT"


def _sampled(y: str, x: str) -> str:
    """SQL of bilinear values at places that depend on row i // 8 and column i % 8."""
    corner = lambda dy, dx: f"p[{_mirror(f'floor(s.y)::INT + {dy}')} * 8 + {_mirror(f'floor(s.x)::INT + {dx}')} + 1]"
    fy, fx = "(s.y - floor(s.y))", "(s.x - floor(s.x))"
    total = f"{corner(0, 0)} * (1 - {fx}) * (1 - {fy}) + {corner(0, 1)} * {fx} * (1 - {fy}) + ({corner(1, 0)} * (1 - {fx}) * {fy}) + {corner(1, 1)} * {fx} * {fy}"
    return f"[least(greatest(round_even({total}, 0), 0), 255)::INT for s in [{{'y': ({y})::DOUBLE, 'x': ({x})::DOUBLE}} for i in range(64)]]"


def _along(k: str) -> str:
    new = "greatest(round_even(8 * large, 0), 1)"
    return f"least(greatest(({k} + floor(({new} - 8) / 2) + 0.5::DOUBLE) * 8 / {new} - 0.5::DOUBLE, 0), 7)"


def _taps(taps, source: str) -> str:
    """SQL of a correlation of the list `source` with literal taps."""
    ry, rx = taps.shape[0] // 2, taps.shape[1] // 2
    parts = [f"{float(taps[i, j])!r}::DOUBLE * {source}[{_mirror(f'(k // 8)::INT + {i - ry}')} * 8 + {_mirror(f'(k % 8)::INT + {j - rx}')} + 1]" for i, j in zip(*taps.nonzero(), strict=True)]
    return f"[list_sum([{', '.join(parts)}]) for k in range(64)]"


def _reduced() -> tuple[str, str]:
    """SQL of the cells that each new row or column covers, and of the reduced image from them."""
    new, at = "greatest(round_even(8 * small, 0), 1)", lambda k: _mirror(f"({k}) - floor((8 - n) / 2)::INT", "n")
    cells = lambda k: (
        f"[{{'i': c, 's': (least(c + 1, ({at(k)} + 1) * (8::DOUBLE / n)) - greatest(c, {at(k)} * (8::DOUBLE / n))) / (8::DOUBLE / n)}} "
        f"for c in range(floor({at(k)} * (8::DOUBLE / n))::INT, least(ceil(({at(k)} + 1) * (8::DOUBLE / n)), 8)::INT)]"
    )
    return (
        f"SELECT *, [{cells('k')} for k in range(8)] AS cells FROM (SELECT *, {new}::INT AS n FROM g)",
        "[least(greatest(round_even(list_sum([y.s * list_sum([x.s * p[y.i * 8 + x.i + 1] for x in cells[k % 8 + 1]]) for y in cells[k // 8 + 1]]), 0), 0), 255)::INT for k in range(64)]",
    )


def _draw(at: str, seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || vec_id || ':' || ({at})), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


#: The chain of augmented_images: five kernels with gates and parameters of their own, and one that always fails.
CHAIN = ("horizontal_flip", "brightness", "broken", "gaussian_blur_random", "gamma", "salt_pepper")


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of every image through a chain, each kernel with probability one half."""
    known = chain.default_kernels() | {"broken": chain.Kernel(lambda image, drawn: F.lit(None).cast("array<int>"))}
    ready = gray(spark, sf_dir).select(F.concat(F.lit("img/"), "vec_id").alias("path"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("p").alias("pixels"))
    done = chain.apply_chain(ready, list(CHAIN), F.concat_ws(":", "path", "copy"), known, seed=3, channels=1)
    return done.select("path", "copy", F.array_join("applied", "_").alias("applied"), F.sha2(text(F.col("pixels")), 256).alias("sha256"), "error")


def drawn_blurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image blurred by a size from 3 to 11 and a deviation of its own (0: by the size), and along a motion of its own."""
    p, size = F.col("p"), F.lit(3) + 2 * (F.col("vec_id") % 5)
    sigma = F.when(F.col("vec_id") % 3 == 0, F.lit(0.0)).otherwise(parameter(20, 0.1, 0.1))
    return gray(spark, sf_dir).select(
        "vec_id",
        text(warps.blurred(p, 8, 8, warps.gaussian_taps(size, sigma))).alias("blurred"),
        text(warps.smeared(p, 8, 8, warps.motion_taps(size, parameter(37, 0.0, 5.0)))).alias("smeared"),
    )


def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image at a size of its own, from 3 x 4 to 13 x 12: by areas if it gets smaller, else bilinear."""
    tall, wide = F.lit(3) + F.col("vec_id") % 11, F.lit(4) + F.col("vec_id") % 9
    small = warps.resized(F.col("p"), 8, 8, tall, wide, F.least(tall, wide) < 8)
    values = F.transform(small, lambda v: F.format_string("%.3f", v + 0.0001))
    return gray(spark, sf_dir).select("vec_id", F.array_join(values, " ").alias("resized"))


def morphed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with the next one of its label, by four landmarks that lie at their brightest quarters."""
    known = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    point = lambda k: F.struct((F.lit(1.0 + 3 * (k % 2)) + F.element_at("p", k + 1) % 3).alias("x"), (F.lit(1.0 + 3 * (k // 2)) + F.element_at("p", k + 9) % 3).alias("y"))
    ready = gray(spark, sf_dir).select("vec_id", pixels.packed(F.flatten(F.transform("p", lambda p: F.array(p, p, p)))).alias("data"), F.array(*[point(k) for k in range(4)]).alias("points"))
    after = known.withColumn("next", F.col("vec_id") + 10)
    sides = [ready.select(*[F.col(c).alias(f"{c}_{s}") for c in ready.columns]) for s in "ab"]
    pairs = after.join(sides[0], F.col("vec_id") == F.col("vec_id_a")).join(sides[1], F.col("next") == F.col("vec_id_b"))
    named = pairs.select(F.concat_ws("_", F.lit("morph"), "vec_id_a", "vec_id_b").alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"), "data_a", "data_b", "points_a", "points_b")
    return morphs.morph(named).select("name", F.sha2("data", 256).alias("sha256"), "error")


def morphed_by_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, as pixels from the start; places of pixels are found by unfolding triangles, and grouped."""
    names, point = ("pixels", "points"), lambda k: F.struct((F.lit(1.0 + 3 * (k % 2)) + F.element_at("p", k + 1) % 3).alias("x"), (F.lit(1.0 + 3 * (k // 2)) + F.element_at("p", k + 9) % 3).alias("y"))
    ready = gray(spark, sf_dir).select("vec_id", F.flatten(F.transform("p", lambda p: F.array(p, p, p))).alias("pixels"), F.array(*[point(k) for k in range(4)]).alias("points"))
    a, b = (ready.select("vec_id", *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "ab")
    pairs = a.join(b.withColumn("vec_id", F.col("vec_id") - 10), "vec_id").withColumn("name", F.concat_ws("_", F.lit("morph"), "vec_id", F.col("vec_id") + 10))
    done = morphs.morph_pixels(pairs.withColumn("height", F.lit(8)).withColumn("width", F.lit(8)))
    return done.select("name", F.sha2(pixels.packed(F.col("pixels")), 256).alias("sha256"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier of label 0 against the rest, trained on and applied to all embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))
    return rounded(model.predict(model.train(rows), rows).select("vec_id", "label", "probability", "predicted_label"), 4)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image as a normalised, channel-first model input of its own size; as text, 10 higher so that no zero has a sign."""
    values = F.transform(F.col("values"), lambda v: F.format_string("%.3f", v.cast("double") + 10.0))
    return faces.model_inputs(images(spark, sf_dir), size=8).select("path", F.array_join(values, " ").alias("values"))


def face_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright 4 x 4 crops by detections made of each image's bytes; every fifth score is too low."""
    at = lambda k, n: (F.element_at("p", k) % n).cast("double")
    eyes = F.create_map(F.lit("left_eye"), F.array(at(1, 3) + 4.0, at(2, 3)), F.lit("right_eye"), F.array(at(3, 3), at(4, 3)))
    area = F.array(*[F.lit(x).cast("int") + (F.element_at("p", k) % 2) for k, x in ((5, 0), (6, 1), (7, 5), (8, 6))])
    score = F.when(F.col("vec_id") % 5 == 0, 0.5).otherwise(0.95)
    face = F.struct(score.alias("score"), area.alias("facial_area"), eyes.alias("landmarks"))
    known = gray(spark, sf_dir).withColumn("detections", F.create_map(F.lit("face_1"), face))
    done = faces.crop_faces(spread(coloured(known, "detections"), "path"), size=4)
    return rounded(done.select("path", "success", "failure_reason", "angle", F.sha2("data", 256).alias("sha256")))


JOINED = "array_to_string({}, ' ')"
BYTES = "[least(greatest(round_even(v, 0), 0), 255)::INT for v in {}]"


def _uniform(what: str, seed: int = 3, key: str = "key") -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key} || ':' || {what}), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


def _chain_sql() -> str:
    """SQL of augmented_images: one step a kernel, from c0 to c6."""
    pixel = lambda source, y, x: f"{source}[({_mirror(y)}) * 8 + ({_mirror(x)}) + 1]"
    down = f"[list_sum([line[t + 1] * {pixel('p', '(k // 8 + t - len(line) // 2)::INT', '(k % 8)::INT')} for t in range(len(line))]) for k in range(64)]"
    across = f"[least(greatest(round_even(list_sum([line[t + 1] * {pixel('half', '(k // 8)::INT', '(k % 8 + t - len(line) // 2)::INT')} for t in range(len(line))]), 0), 0), 255)::INT for k in range(64)]"
    draw = lambda name, what: _uniform(f"'{name}.{what}'")
    speck = lambda seed: _uniform("i", seed, "key || ':salt_pepper'")
    steps = {
        "horizontal_flip": ("SELECT *, 0 AS x FROM {}", "[p[(i // 8) * 8 + 8 - i % 8] for i in range(64)]"),
        "brightness": (f"SELECT *, 0.7::DOUBLE + {float(1.3 - 0.7)!r}::DOUBLE * {draw('brightness', 'factor')} AS x FROM {{}}", "[least(round_even(v * x, 0), 255)::INT for v in p]"),
        "gaussian_blur_random": (
            f"SELECT *, {down} AS half FROM (SELECT *, [e / list_sum(es) for e in es] AS line FROM (SELECT *, [exp(-pow(i - size // 2, 2) / (2 * sigma * sigma)) for i in range(size)] AS es FROM "
            f"(SELECT *, (3 + 2 * floor(4 * {draw('gaussian_blur_random', 'kernel_size')}))::INT AS size, 0.1::DOUBLE + {float(2.0 - 0.1)!r}::DOUBLE * {draw('gaussian_blur_random', 'sigma')} AS sigma FROM {{}})))",
            across,
        ),
        "gamma": (f"SELECT *, 0.7::DOUBLE + {float(1.5 - 0.7)!r}::DOUBLE * {draw('gamma', 'gamma')} AS x FROM {{}}", "[floor(pow(v / 255.0::DOUBLE, x) * 255)::INT for v in p]"),
        "salt_pepper": (
            f"SELECT *, 0.01::DOUBLE + {float(0.05 - 0.01)!r}::DOUBLE * {draw('salt_pepper', 'noise_probability')} AS x FROM {{}}",
            f"[CASE WHEN {speck(0)} >= x THEN p[i + 1] WHEN {speck(1)} < 0.5::DOUBLE THEN 255 ELSE 0 END for i in range(64)]",
        ),
    }
    parts = ["c0 AS (SELECT 'img/' || vec_id AS path, copy, 'img/' || vec_id || ':' || copy AS key, p, []::VARCHAR[] AS applied, NULL::VARCHAR AS error FROM g, (SELECT unnest([0, 1]) AS copy))"]
    for k, name in enumerate(CHAIN):
        gate = f"{draw(name, 'gate')} < 0.5::DOUBLE"
        if name == "broken":
            parts.append(f"c{k + 1} AS (SELECT path, copy, key, p, applied, CASE WHEN {gate} THEN 'broken: no image of the old size' END AS error FROM c{k})")
            continue
        source, made = steps[name]
        parts.append(f"c{k + 1} AS (SELECT path, copy, key, CASE WHEN {gate} THEN {made} ELSE p END AS p, CASE WHEN {gate} THEN applied || ['{name}'] ELSE applied END AS applied, error FROM ({source.format(f'c{k}')}))")
    return f"WITH {GRAY}, {', '.join(parts)} SELECT path, copy, array_to_string(applied, '_') AS applied, sha256(array_to_string(p, ' ')) AS sha256, error FROM c{len(CHAIN)}"


def _blurs_sql() -> str:
    pixel = lambda source, y, x: f"{source}[({_mirror(y)}) * 8 + ({_mirror(x)}) + 1]"
    fixed = " ".join(f"WHEN sigma = 0 AND size = {n} THEN {list(line)}::DOUBLE[]" for n, line in kernels.SMALL_KERNELS.items())
    spread = "CASE WHEN sigma > 0 THEN sigma ELSE 0.3::DOUBLE * ((size - 1) * 0.5::DOUBLE - 1) + 0.8::DOUBLE END"
    along = "(cos(radians(angle)) * t.x - sin(radians(angle)) * t.y + size // 2)"
    inside = lambda at, share: f"CASE WHEN {at} >= 0 AND {at} < size THEN {share} ELSE 0 END"
    tap = f"greatest(1 - abs(sin(radians(angle)) * t.x + cos(radians(angle)) * t.y), 0) * ({inside(f'floor({along})', f'1 - ({along} - floor({along}))')} + {inside(f'floor({along}) + 1', f'{along} - floor({along})')})"
    cells = "[{'y': k // size - size // 2, 'x': k % size - size // 2} for k in range(size * size)]"
    down = f"[list_sum([line[t + 1] * {pixel('p', '(k // 8 + t - size // 2)::INT', '(k % 8)::INT')} for t in range(size)]) for k in range(64)]"
    across = f"[list_sum([line[t + 1] * {pixel('half', '(k // 8)::INT', '(k % 8 + t - size // 2)::INT')} for t in range(size)]) for k in range(64)]"
    smear = f"[list_sum([t.k / total * {pixel('p', '(i // 8 + t.y)::INT', '(i % 8 + t.x)::INT')} for t in taps]) for i in range(64)]"
    return f"""WITH {GRAY}, a AS (SELECT *, (3 + 2 * (vec_id % 5))::INT AS size, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 0.1::DOUBLE + 0.1::DOUBLE * (vec_id % 20) END AS sigma, 5::DOUBLE * (vec_id % 37) AS angle FROM g),
  b AS (SELECT *, [exp(-pow(i - size // 2, 2) / (2 * ({spread}) * ({spread}))) for i in range(size)] AS es, [{{'y': t.y, 'x': t.x, 'k': {tap}}} for t in {cells}] AS taps FROM a),
  c AS (SELECT *, CASE {fixed} ELSE [e / list_sum(es) for e in es] END AS line, list_sum([t.k for t in taps]) AS total FROM b),
  d AS (SELECT *, {down} AS half FROM c)
  SELECT vec_id, {JOINED.format(BYTES.format(across))} AS blurred, {JOINED.format(BYTES.format(smear))} AS smeared FROM d"""


def _weights_sql(new: str) -> str:
    """SQL of the lists of weights from 8 old cells to `new` ones, by area or bilinear."""
    step = f"(8::DOUBLE / {new})"
    area = f"[[{{'i': c, 'k': (least(c + 1, (n + 1) * {step}) - greatest(c, n * {step})) / {step}}} for c in range(floor(n * {step})::INT, least(ceil((n + 1) * {step}), 8)::INT)] for n in range({new})]"
    at = f"least(greatest((n + 0.5::DOUBLE) * {step} - 0.5::DOUBLE, 0), 7)"
    line = f"[[{{'i': floor({at})::INT, 'k': 1 - ({at} - floor({at}))}}, {{'i': least(floor({at}) + 1, 7)::INT, 'k': {at} - floor({at})}}] for n in range({new})]"
    return f"CASE WHEN least(tall, wide) < 8 THEN {area} ELSE {line} END"


RESIZED = f"""WITH {GRAY}, a AS (SELECT *, (3 + vec_id % 11)::INT AS tall, (4 + vec_id % 9)::INT AS wide FROM g),
  b AS (SELECT *, {_weights_sql("tall")} AS down, {_weights_sql("wide")} AS across FROM a),
  c AS (SELECT *, [list_sum([t.k * p[t.i * 8 + k % 8 + 1] for t in down[k // 8 + 1]]) for k in range(tall * 8)] AS half FROM b)
  SELECT vec_id, array_to_string([format('{{:.3f}}', list_sum([t.k * half[k // wide * 8 + t.i + 1] for t in across[k % wide + 1]]) + 0.0001::DOUBLE) for k in range(tall * wide)], ' ') AS resized FROM c"""


def _faces_sql() -> str:
    """SQL of face_pixels: the box turned with the eyes' angle, the image sampled there, and areas of the crop."""
    corners = [f"a * {x} + b * {y} + (1 - a) * 4.0::DOUBLE - b * 4.0::DOUBLE" for x in ("x1", "x2") for y in ("y1", "y2")]
    rises = [f"-b * {x} + a * {y} + b * 4.0::DOUBLE + (1 - a) * 4.0::DOUBLE" for x in ("x1", "x2") for y in ("y1", "y2")]
    step = "((hi - lo)::DOUBLE / 4)"
    cells = lambda lo, hi: (
        f"[[{{'i': {lo} + c, 'k': (least(c + 1, (n + 1) * ST) - greatest(c, n * ST)) / ST}} for c in range(floor(n * ST)::INT, least(ceil((n + 1) * ST), {hi} - {lo})::INT)] for n in range(4)]".replace("ST", step.replace("hi", hi).replace("lo", lo))
    )
    value = "[least(greatest(round_even(list_sum([x.k * list_sum([y.k * up[y.i * 8 + x.i + 1] for y in down[k // 4 + 1]]) for x in across[k % 4 + 1]]), 0), 0), 255)::INT for k in range(16)]"
    return f"""WITH {GRAY}, d AS (SELECT *, p[3] % 3 AS lx, p[4] % 3 AS ly, p[1] % 3 + 4 AS rx, p[2] % 3 AS ry, p[5] % 2 AS x1, 1 + p[6] % 2 AS y1, 5 + p[7] % 2 AS x2, 6 + p[8] % 2 AS y2, vec_id % 5 > 0 AS good FROM g),
  t AS (SELECT *, degrees(atan2((ry - ly)::DOUBLE, (rx - lx)::DOUBLE)) AS angle FROM d), r AS (SELECT *, cos(radians(angle)) AS a, sin(radians(angle)) AS b FROM t),
  h AS (SELECT *, floor(least({", ".join(corners)}))::INT AS bx1, floor(least({", ".join(rises)}))::INT AS by1, ceil(greatest({", ".join(corners)}))::INT AS bx2, ceil(greatest({", ".join(rises)}))::INT AS by2 FROM r),
  m AS (SELECT *, greatest(0, bx1 - trunc((bx2 - bx1) * 0.3::DOUBLE)::INT) AS cx1, greatest(0, by1 - trunc((by2 - by1) * 0.3::DOUBLE)::INT) AS cy1,
    least(8, bx2 + trunc((bx2 - bx1) * 0.3::DOUBLE)::INT) AS cx2, least(8, by2 + trunc((by2 - by1) * 0.3::DOUBLE)::INT) AS cy2 FROM h),
  u AS (SELECT *, {_sampled("b * (i % 8 - 4) + a * (i // 8 - 4) + 4", "a * (i % 8 - 4) - b * (i // 8 - 4) + 4")} AS up, {cells("cy1", "cy2")} AS down, {cells("cx1", "cx2")} AS across FROM m),
  f AS (SELECT *, {value} AS q FROM u)
  SELECT concat('img/', vec_id) AS path, good AS success, CASE WHEN NOT good THEN 'All detections below score threshold (best=0.500, threshold=0.900)' END AS failure_reason,
    CASE WHEN good THEN round(angle, 6) END AS angle, CASE WHEN good THEN sha256(unhex(array_to_string([printf('%02X%02X%02X', v, v, v) for v in q], ''))) END AS sha256 FROM f"""


QUERIES = {"point_kernels": point_kernels, "warped_images": warped, "smoothed_images": smoothed, "noisy_images": noisy, "recompressed_images": recompressed, "augmented_images": augmented, "drawn_blurs": drawn_blurs, "resized_images": resized_images, "morphed_images": morphed, "morph_places": morphed_by_places, "scored_embeddings": scored, "model_inputs": inputs, "face_pixels": face_pixels}

ORACLES = {
    "augmented_images": _chain_sql(),
    "drawn_blurs": _blurs_sql(),
    "resized_images": RESIZED,
    "face_pixels": _faces_sql(),
    "warped_images": f"""WITH {GRAY.replace(" AS p FROM embeddings", """ AS p, -15::DOUBLE + 1::DOUBLE * (vec_id % 31) AS angle, -0.1::DOUBLE + 0.01::DOUBLE * (vec_id % 21) AS sx, -0.09::DOUBLE + 0.01::DOUBLE * (vec_id % 19) AS sy,
    1::DOUBLE + 0.05::DOUBLE * (vec_id % 5) AS large, 0.7::DOUBLE + 0.05::DOUBLE * (vec_id % 5) AS small FROM embeddings""")},
  t AS (SELECT *, cos(radians(angle)) AS a, sin(radians(angle)) AS b FROM ({_reduced()[0]}))
  SELECT vec_id, {JOINED.format(_sampled("b * (i % 8 - 4) + a * (i // 8 - 4) + 4", "a * (i % 8 - 4) - b * (i // 8 - 4) + 4"))} AS rotated,
    {JOINED.format(_sampled("i // 8 - sy * 8", "i % 8 - sx * 8"))} AS shifted, {JOINED.format(_sampled(_along("i // 8"), _along("i % 8")))} AS enlarged,
    {JOINED.format(_reduced()[1])} AS reduced FROM t""",
    "smoothed_images": f"""WITH {GRAY}, d AS (SELECT *, {_taps(kernels.gaussian_line(5, 0.0)[:, None], "p")} AS d5, {_taps(kernels.gaussian_line(9, 1.3)[:, None], "p")} AS d9,
    {_taps(kernels.gaussian_line(19, 3.0)[:, None], "p")} AS d19, 0.5::DOUBLE + 0.5::DOUBLE * (vec_id % 4) AS strength FROM g),
  e AS (SELECT *, {_taps(kernels.gaussian_line(19, 3.0)[None, :], "d19")} AS soft FROM d)
  SELECT vec_id, {JOINED.format(BYTES.format(_taps(kernels.gaussian_line(5, 0.0)[None, :], "d5")))} AS blurred, {JOINED.format(BYTES.format(_taps(kernels.gaussian_line(9, 1.3)[None, :], "d9")))} AS blurred_wide,
    {JOINED.format(BYTES.format(_taps(kernels.motion(5, 30.0), "p")))} AS smeared,
    {JOINED.format("[least(greatest(round_even((1 + strength) * p[k + 1] - strength * soft[k + 1], 0), 0), 255)::INT for k in range(64)]")} AS sharpened FROM e""",
    "recompressed_images": f"""WITH {GRAY}, b AS (SELECT vec_id, [x - 128::DOUBLE for x in p] AS d, {warps._cosines()}::DOUBLE[] AS c, 30 + vec_id % 61 AS q, {kernels.LUMINANCE} AS t FROM g),
  s AS (SELECT *, [greatest(least((x * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END + 50) // 100, 255), 1)::DOUBLE for x in t] AS table_ FROM b),
  e AS (SELECT *, {_cosine_sum("(c[(f // 8) * 8 + k // 8 + 1] * c[(f % 8) * 8 + k % 8 + 1])", "d")} AS raw FROM s),
  r AS (SELECT *, [round_even(raw[f + 1] / table_[f + 1], 0) * table_[f + 1] for f in range(64)] AS kept FROM e),
  z AS (SELECT *, {_cosine_sum("(c[(k // 8) * 8 + f // 8 + 1] * c[(k % 8) * 8 + f % 8 + 1])", "kept")} AS back FROM r)
  SELECT vec_id, {JOINED.format(BYTES.format("[x + 128 for x in back]"))} AS recompressed FROM z""",
    "noisy_images": f"""WITH {GRAY} SELECT vec_id,
    {JOINED.format(f"[floor(least(greatest(p[i + 1] + (2 + 1::DOUBLE * (vec_id % 14)) * (sqrt(-2 * ln({_draw('i', 3)})) * cos(2 * pi() * {_draw('i', 4)})), 0), 255))::INT for i in range(64)]")} AS noisy,
    {JOINED.format(f"[CASE WHEN {_draw('i', 5)} >= 0.01::DOUBLE + 0.01::DOUBLE * (vec_id % 5) THEN p[i + 1] WHEN {_draw('i', 6)} < 0.5::DOUBLE THEN 255 ELSE 0 END for i in range(64)]")} AS speckled FROM g""",
    "point_kernels": f"""WITH {GRAY}, m AS (SELECT *, list_avg(p) AS mean, round_even(list_avg(p), 0) AS whole FROM g)
  SELECT vec_id, array_to_string([p[(i // 8) * 8 + 8 - i % 8] for i in range(64)], ' ') AS flipped,
    array_to_string([least(round_even(x * 1.3::DOUBLE, 0), 255)::INT for x in p], ' ') AS brightened,
    array_to_string([floor(least(greatest(mean + 1.3::DOUBLE * (x - mean), 0), 255))::INT for x in p], ' ') AS contrasted,
    array_to_string([least(round_even(abs(1.3::DOUBLE * x + whole * (1 - 1.3::DOUBLE)), 0), 255)::INT for x in p], ' ') AS contrasted_rounded,
    array_to_string([floor(pow(x / 255.0::DOUBLE, 1.5::DOUBLE) * 255)::INT for x in p], ' ') AS gamma,
    array_to_string([p[(i // 4) * 16 + (i % 4) * 2 + 1] for i in range(16)], ' ') AS resized FROM m""",
    "model_inputs": f"""WITH {GRAY}
  SELECT concat('img/', vec_id) AS path, concat_ws(' ', {", ".join(f"array_to_string([format('{{:.3f}}', ((x / 255.0::DOUBLE - {m}::DOUBLE) / {d}::DOUBLE)::FLOAT::DOUBLE + 10) for x in p], ' ')" for m, d in zip(faces.CHANNEL_MEAN, faces.CHANNEL_DEVIATION, strict=True))}) AS values FROM g""",
}
