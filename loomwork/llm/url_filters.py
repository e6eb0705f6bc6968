"""URL filters: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.llm.texts import LOWER, UPPER
from loomwork.session import materialise, shared_dir

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Words of host names by which URLs are labelled for training: gambling, drugs, adult, loans, spam, advertising.
SEED_TERMS = ("ads", "adult", "bet", "bets", "casino", "escort", "lottery", "payday", "pills", "poker", "porn", "slots", "spam", "viagra", "xxx")

#: What stands beside a word in made-up host names, and common words that junk doesn't use, some of them with a seed term inside.
AFFIXES = ("online", "shop", "now", "best", "my", "free", "24", "top", "world", "club", "live", "pro")
COMMON_WORDS = (
    "school", "garden", "music", "library", "news", "coca", "cola", "city", "market", "museum", "travel", "recipe", "health", "sport", "weather",
    "academic", "forum", "history", "science", "bakery", "hotel", "church", "theatre", "photo", "kitchen", "river", "nature", "studio", "book", "craft",
    "alphabet", "better", "roads", "downloads", "leads", "pillow", "adulthood", "spamalot", "slotcar", "betony", "expressway", "spokesman", "casings", "lots",
)
#: Log-odds of character n-grams are kept for so many hashes.
GRAM_BUCKETS = 4096
GRAM_SIZES = (3, 4, 5)

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digits", "f_hyphens",
    "f_entropy", "f_parameters", "f_query_length", "f_fragment", "f_https", "f_suffix_blocked", "f_suffix_seen",
    "f_domain_blocked", "f_domain_seen", "f_gram_most", "f_gram_high", "f_gram_mean", "f_gram_least", "f_word_most", "f_word_mean",
]


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (text, verdict), else null; of equally long ones the first by text.

    All rules are one literal array, longest first, and the first that fits is taken.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    table = F.array(
        *[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("text"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    )
    fits = F.filter(
        table,
        lambda r: ((host_col == r["host"]) | host_col.endswith(F.concat(F.lit("."), r["host"]))) & path_col.startswith(r["path"]),
    )
    return F.try_element_at(fits, F.lit(1))


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """df with host, path, suffix, domain and the lexical features of url_col, built-in functions only."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    size = lambda text: F.length(text).cast("double")
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    hosted = df.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    labels = F.split("host", r"\.")
    letters = F.split("host", "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.greatest(F.length("host"), F.lit(1))
    entropy = F.aggregate(F.transform(F.array_distinct(letters), share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return (
        hosted.withColumn("suffix", F.element_at(labels, -1))
        .withColumn("domain", F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2)))
        .withColumn("f_length", size(url))
        .withColumn("f_host_length", size(F.col("host")))
        .withColumn("f_path_length", size(F.col("path")))
        .withColumn("f_depth", count(F.col("path"), "/"))
        .withColumn("f_labels", F.size(labels).cast("double"))
        .withColumn("f_digit_ratio", count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)))
        .withColumn("f_host_digits", count(F.col("host"), "[0-9]"))
        .withColumn("f_hyphens", count(F.col("host"), "-"))
        .withColumn("f_entropy", F.when(F.col("host") == "", 0.0).otherwise(entropy))
        .withColumn("f_parameters", F.when(asked == "", 0.0).otherwise(count(asked, "[&;]") + 1))
        .withColumn("f_query_length", size(asked))
        .withColumn("f_fragment", F.contains(url, F.lit("#")).cast("double"))
        .withColumn("f_https", F.startswith(url, F.lit("https://")).cast("double"))
    )


def host_words(host_col: Column) -> Column:
    """The labels of a host and their hyphenated parts, without the last label."""
    return F.filter(F.split(F.regexp_replace(host_col, r"[.][^.]*$", ""), "[.-]"), lambda w: w != "")


def gram_buckets(words: Column) -> Column:
    """Hashes of the character n-grams of the words, `^` and `$` at their ends, as distinct places from 1 to GRAM_BUCKETS."""
    place = lambda g: (F.pmod(F.xxhash64(g), F.lit(GRAM_BUCKETS)) + 1).cast("int")

    def of(word: Column) -> Column:
        marked = F.concat(F.lit("^"), word, F.lit("$"))
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i: place(F.substring(marked, i, F.lit(n))))
        return F.flatten(F.array(*[cut(n) for n in GRAM_SIZES]))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def word_buckets(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: (F.pmod(F.xxhash64(F.lit(3), w), F.lit(GRAM_BUCKETS)) + 1).cast("int")))


#: Parts of all hosts: a training URL's suffix and domain statistics come from the hosts of the other parts.
FOLDS = 5


def _fold(host_col: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), host_col), F.lit(FOLDS))


def _looked_up(table: Column, places: Column) -> Column:
    return F.transform(places, lambda p: F.element_at(table, p))


class UrlModel:
    """Boosted trees with the suffix, domain, n-gram and word statistics of their training URLs.

    odds: for "gram" and "word" the log-odds of each bucket from all folds but one, for every fold, and from all at the end.
    """

    def __init__(self, trees, suffixes: DataFrame | None, domains: DataFrame | None, constant: float, odds: dict[str, list[list[float]]] | None = None):
        self.trees, self.suffixes, self.domains, self.constant, self.odds = trees, suffixes, domains, constant, odds or {}

    def importance(self) -> dict[str, float]:
        """Each feature's share of what the trees gain."""
        return dict(zip(FEATURES, self.trees.featureImportances.toArray().tolist(), strict=True)) if self.trees else {}

    def spelling(self, df: DataFrame, apart: bool) -> DataFrame:
        """df with the n-gram and word features of host: what the hashes of a host say of it, each from a fixed table of numbers."""
        words = host_words(F.col("host"))
        for kind, buckets in (("gram", gram_buckets(words)), ("word", word_buckets(words))):
            tables = [F.split(F.lit(",".join(f"{x:.5f}" for x in t)), ",").cast("array<double>") for t in self.odds[kind]]
            table = F.element_at(F.array(*tables[:-1]), (F.col("fold") + 1).cast("int")) if apart else tables[-1]
            df = df.withColumn("_odds", F.sort_array(_looked_up(table, buckets), asc=False))
            mean = lambda a: F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a)), F.lit(0.0))
            df = df.withColumn(f"f_{kind}_most", F.coalesce(F.array_max("_odds"), F.lit(0.0))).withColumn(f"f_{kind}_mean", mean(F.col("_odds")))
            if kind == "gram":
                df = df.withColumn("f_gram_high", mean(F.slice("_odds", 1, 4))).withColumn("f_gram_least", F.coalesce(F.array_min("_odds"), F.lit(0.0)))
        return df.drop("_odds")

    def statistics(self, df: DataFrame, apart: bool = False) -> DataFrame:
        """df with smoothed shares of blocked URLs and counts by suffix and domain; with `apart`, without the URLs of the row's own fold.

        Tables have at most FOLDS + 1 rows per training URL, so their size is bounded and they are broadcast.
        """
        for key, table in (("suffix", self.suffixes), ("domain", self.domains)):
            whole = table.groupBy(key).agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"))
            df = df.join(F.broadcast(whole), key, "left")
            if apart:
                mine = table.select(key, "fold", F.col("n").alias("_own_n"), F.col("bad").alias("_own_bad"))
                df = df.join(F.broadcast(mine), [key, "fold"], "left")
                df = df.withColumn("_n", F.col("_n") - F.coalesce("_own_n", F.lit(0.0))).withColumn("_bad", F.col("_bad") - F.coalesce("_own_bad", F.lit(0.0)))
            n, bad = F.coalesce("_n", F.lit(0.0)), F.coalesce("_bad", F.lit(0.0))
            df = df.withColumn(f"f_{key}_blocked", (bad + 20 * self.constant) / (n + 20)).withColumn(f"f_{key}_seen", F.log(n + 1.0))
            df = df.drop("_n", "_bad", "_own_n", "_own_bad")
        return df

    def predict(self, featured: DataFrame) -> DataFrame:
        """featured with column blocked, 1.0 or 0.0."""
        if self.trees is None:
            return featured.withColumn("blocked", F.lit(float(self.constant > 0.5)))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(self.spelling(self.statistics(featured), False))
        return self.trees.transform(vectors).withColumnRenamed("prediction", "blocked")


def training_sample(known: DataFrame, url_col: str, label_col: str, train_rows: int) -> DataFrame:
    """(url, label, weight): at most train_rows distinct URLs, half of them of each label where both have so many.

    Those of least hash among a share of each label's rows; a repeated URL is one row with its number as weight, and
    weights bring the labels back to their true shares.
    """
    half, parts = train_rows // 2, []
    for label in (0, 1):
        rows = known.where(F.col(label_col) == label).select(F.col(url_col).alias("url"))
        n = rows.count()
        mark = F.xxhash64(F.lit(11), "url")
        if n > half:
            rows = rows.where(F.pmod(mark, F.lit(1 << 30)) < int(min(1.0, 2 * half / n) * (1 << 30)))
        distinct = rows.groupBy("url").agg(F.count("*").cast("double").alias("seen")).orderBy(F.pmod(mark, F.lit(1 << 30)), "url").limit(half)
        parts.append((n, materialise(distinct.withColumn("label", F.lit(float(label))), f"url-sample-{label}")))
    sized = [part.withColumn("weight", F.col("seen") * F.lit(n / (part.agg(F.sum("seen")).first()[0] or 1.0))) for n, part in parts]
    return sized[0].unionByName(sized[1]).select("url", "label", "weight")


def one_per_host(known: DataFrame, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """(url, label): for each host the URL of least hash, with the label that more of its URLs have, so that no host outweighs another."""
    rows = known.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"))
    return rows.groupBy(host(F.col("url")).alias("_host")).agg(F.min_by("url", F.struct(F.xxhash64(F.lit(13), "url"), "url")).alias("url"), (F.avg("label") > 0.5).cast("int").alias("label")).select("url", "label")


def _log_odds(featured: DataFrame, buckets: Column) -> list[list[float]]:
    """Smoothed log-odds of label 1 for each bucket, by all folds but each one and by all; labels weigh alike, absent buckets 0."""
    weights = {r.label: r.w for r in featured.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    even = F.when(F.col("label") == 1.0, F.col("weight") / weights[1.0]).otherwise(F.col("weight") / weights[0.0])
    seen = featured.select("fold", "label", even.alias("share"), F.explode(buckets).alias("bucket")).groupBy("fold", "bucket", "label").agg(F.sum("share").alias("share"))
    counts = np.zeros((FOLDS, 2, GRAM_BUCKETS))
    for r in seen.collect():  # at most 2 * FOLDS * GRAM_BUCKETS rows
        counts[r.fold, int(r.label), r.bucket - 1] = r.share
    smooth, total = 0.002, counts.sum(axis=0)
    odds = lambda c: np.log((c[1] + smooth) / (c[0] + smooth)).tolist()
    return [odds(total - counts[k]) for k in range(FOLDS)] + [odds(total)]


def train(
    labelled: DataFrame, url_col: str = "url", label_col: str = "label", train_rows: int = 20_000, rounds: int = 20, depth: int = 4,
    per_host: bool = False, most_share: float = 1.0, feature_share: float = 1.0,
) -> UrlModel:
    """Fit on labelled URLs, label 1 for block and 0 for allow.

    At most train_rows of them are used, so that the fit's cost does not grow with the input; everything else in this
    module covers all rows. With per_host each host counts once. Suffix, domain, n-gram and word statistics are
    smoothed shares and log-odds; a training URL's own are those of other hosts, as its label must not show in its
    features. Each split looks at a feature_share of the features. Trees whose gain comes to more than most_share from one
    feature have learnt a single question and are refused: the model is then the constant. So it is without
    URLs of both labels: what it has seen, allow if nothing.
    """
    known = labelled.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull())
    if per_host:
        known, url_col, label_col = materialise(one_per_host(known, url_col, label_col), "url-hosts"), "url", "label"
    constant = known.agg(F.avg(F.col(label_col).cast("double")).alias("p")).first()["p"] or 0.0
    if constant in (0.0, 1.0):
        return UrlModel(None, None, None, constant)
    featured = materialise(lexical(training_sample(known, url_col, label_col, train_rows), "url").withColumn("fold", _fold(F.col("host"))), "url-features")
    tables = {
        key: materialise(
            featured.groupBy(key, "fold").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("bad")), f"url-{key}"
        )
        for key in ("suffix", "domain")
    }
    words = host_words(F.col("host"))
    odds = {"gram": _log_odds(featured, gram_buckets(words)), "word": _log_odds(featured, word_buckets(words))}
    model = UrlModel(None, tables["suffix"], tables["domain"], constant, odds)
    ready = model.spelling(model.statistics(featured, apart=True), apart=True)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(ready).select("_features", "label", "weight")
    shared_dir(labelled.sparkSession)
    model.trees = GBTClassifier(
        featuresCol="_features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=32, seed=7, featureSubsetStrategy=str(feature_share) if feature_share < 1 else "all"
    ).fit(materialise(rows, "url-vectors"))
    if max(model.importance().values()) > most_share:
        return UrlModel(None, None, None, 0.0)
    return model


def held_out(labelled: DataFrame, url_col: str = "url", label_col: str = "label", **options) -> DataFrame:
    """(fold, caught, missed, wrong, right): numbers of labelled URLs of each part of all hosts, judged by trees that saw none of these hosts."""
    known = labelled.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).alias("label"))
    known = materialise(known.withColumn("fold", _fold(host(F.col("url")))), "url-folds")
    parts = []
    for fold in range(FOLDS):
        model = train(known.where(F.col("fold") != fold), "url", "label", **options)
        parts.append(model.predict(lexical(known.where(F.col("fold") == fold), "url")).select("fold", "label", "blocked"))
    judged = parts[0]
    for part in parts[1:]:
        judged = judged.unionByName(part)
    is_bad, said = F.col("label") == 1, F.col("blocked") > 0.5
    return judged.groupBy("fold").agg(
        F.count_if(is_bad & said).alias("caught"), F.count_if(is_bad & ~said).alias("missed"), F.count_if(~is_bad & said).alias("wrong"), F.count_if(~is_bad & ~said).alias("right")
    )


def judge(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest fitting rule decides, else the model.

    DataFrame functions and the JVM's tree ensemble only; no shuffle.

    Cases: a null URL or one without :// has host and path ''; no rule fits it and the model decides from
    its features; repeated rows are judged alike; null ids are kept; an empty table gives no rows; other
    columns are left out.
    """
    featured = lexical(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")), "_url")
    judged = model.predict(featured.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.text").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("blocked") > 0.5, "block").otherwise("allow")).alias("verdict"),
    )


def seed_labels(pages: DataFrame, url_col: str = "url", terms=SEED_TERMS) -> DataFrame:
    """(url, label) for URLs with a host: label 1 where a label or hyphenated part of the host is a seed term.

    Rules state what an owner wants of a site, whatever its URLs look like; what junk looks like is learnt
    from hosts that carry words of public blocklist categories.
    """
    pattern = r"(^|[.-])(" + "|".join(terms) + r")([.-]|$)"
    named = host(F.col(url_col))
    return pages.where(named != "").select(F.col(url_col).alias("url"), named.rlike(pattern).cast("int").alias("label"))


def seed_hosts(spark: SparkSession, terms=SEED_TERMS, common=COMMON_WORDS, affixes=AFFIXES) -> DataFrame:
    """(url, label) of made-up hosts for fitting alone: seed terms (label 1) and common words (0) in the same forms.

    Each word stands before or behind each affix, joined by nothing, a hyphen or a dot, below suffixes and subdomains drawn
    alike for both labels, so that neither hyphens nor length nor paths tell them apart, only what the words are.
    """
    listed = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(label).alias("label")) for label, words in ((1, terms), (0, common)) for w in words])
    words = spark.range(1).select(F.explode(listed).alias("w"), F.lit(0).alias("_")).select("w.*")
    shaped = words.withColumn("affix", F.explode(F.array(*[F.lit(a) for a in affixes]))).withColumn("join", F.explode(F.array(F.lit(""), F.lit("-"), F.lit(".")))).withColumn("front", F.explode(F.array(F.lit(True), F.lit(False))))
    name = F.when(F.col("front"), F.concat("word", "join", "affix")).otherwise(F.concat("affix", "join", "word"))
    drawn = lambda seed, *choices: F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.xxhash64(F.lit(seed), name), F.lit(len(choices))) + 1).cast("int"))
    url = F.concat(F.lit("http"), drawn(1, "", "s"), F.lit("://"), drawn(2, "", "", "www.", "m.", "blog."), name, F.lit("."), drawn(3, "com", "net", "org", "info", "example.com", "example.net", "example.org"), F.lit("/"), drawn(4, "", "en/17", "de/2204/", "fr/9.html", "es/81?page=2&ref=x", "en/5#top"))
    return shaped.select(url.alias("url"), "label")


def query(spark, sf_dir: str) -> DataFrame:
    """Verdicts over pages; the trees learn from hosts labelled by seed terms and from made-up hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    known = seed_labels(pages).unionByName(seed_hosts(spark))
    return judge(pages, train(known, per_host=True, most_share=0.6, feature_share=0.3))
