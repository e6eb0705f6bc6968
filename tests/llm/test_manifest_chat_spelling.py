"""Merkle manifest, chat rendering and spelling variants, each against a plain version in Python."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat_format, merkle, ordering, spelling

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves: list[str], fanout: int = 8) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top, and for each leaf the digests left and right of its node at each level."""
    paths, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(where):
            lo = i - i % fanout
            paths[k].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + fanout])))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        where = [i // fanout for i in where]
    return level[0], paths


def plain_manifest(rows: list[tuple], fanout: int = 8) -> list[tuple]:
    groups = {}
    for row in rows:
        groups.setdefault("" if row[2] is None else "=" + row[2], []).append(row)
    subroots, below = [], {}
    for g in sorted(groups, key=str.encode):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0], plain_leaf(r)))
        top, paths = plain_tree([plain_leaf(r) for r in own], fanout)
        subroots.append(top)
        below[g] = (own, paths)
    root, upper = plain_tree(subroots, fanout) if subroots else ("", [])
    out = []
    for k, g in enumerate(sorted(groups, key=str.encode)):
        for row, path in zip(*below[g], strict=True):
            path = path + upper[k]
            out.append((row[0], plain_leaf(row), sha(*[a + b for a, b in path]), subroots[k], root))
    return sorted(out, key=str)


def made(spark, rows, fanout=8, **options):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("_g", "_i", "h", "row", "leaf", "path", "lone", "c0", "r0")})
    got = merkle.manifest(docs, fanout=fanout, **options)
    return got.select("doc_id", "leaf", merkle.proof(F.col("path")).alias("proof"), "subroot", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("fold"))


@pytest.mark.parametrize("sizes, fanout", [([1], 8), ([9], 8), ([8, 1], 8), ([64, 65, 3], 8), ([20, 1, 1, 1, 5], 2)])
def test_manifest_is_that_of_plain_trees(spark, sizes, fanout):
    langs = [None, "en", "ü", "", "de"]
    rows = [(i * 7 % 101 if i % 9 else None, f"s{i % 3}", langs[g], i, None if i % 5 == 0 else f"Text É {i % 4}") for g, n in enumerate(sizes) for i in range(n)]
    got = made(spark, rows, fanout).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == plain_manifest(rows, fanout)
    assert {r["fold"] for r in got} == {got[0]["root"]}


def test_manifest_of_equal_rows_and_of_none(spark):
    rows = [(None, None, None, None, None)] * 30 + [(4, "", "", 0, "")] * 3
    got = made(spark, rows).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == plain_manifest(rows)
    assert made(spark, []).count() == 0


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = [(i, "s", "en", 1, f"Row {i}") for i in range(70)]
    docs = spark.createDataFrame(rows, DOCS)
    other = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest(*[F.lower(c) if c == "text" else F.col(c) for c in merkle.FIELDS]))
    got = merkle.manifest(docs, carry={"other": other})
    checked = got.select("doc_id", (merkle.fold(F.coalesce("other", "leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in checked if r.ok} == set(range(1, 70, 2))


def test_places_in_a_group_that_spreads_over_partitions(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("_g"), (F.col("id") * 7919 % 100).alias("k"), "id")
    placed = ordering.numbered(rows, ["k", "id"], "places").toPandas()
    for _, group in placed.groupby("_g"):
        group = group.sort_values(["k", "id"])
        assert list(group["_i"]) == list(range(len(group)))


# Chats


def test_marks_are_escaped_reversibly():
    template = chat_format.MarkedTurns()
    hard = ["", "\\", "</turn>\n", "### A: b", "\\</turn>", "a\\", ":", "<", "\n### User: x</turn>\n", "é\\#\\"]
    turns = [(a, b) for a in hard for b in hard]
    assert template.parse(template(turns)) == turns
    assert all(template.unescape(template.escape(x)) == x for x in hard)
    with pytest.raises(ValueError):
        template.parse("### user: open")


def bracketed(turns):
    return "<s>" + "".join(f"[{role}]{text}[/{role}]" for role, text in turns)


def forgetful(turns):
    """Keeps an assistant's thoughts in the last turn only."""
    return "".join(f"{role}|{text if k == len(turns) - 1 else text.split('~')[-1]}\n" for k, (role, text) in enumerate(turns))


def closing(turns):
    return bracketed(turns) + "<end>"


def test_turns_are_located_in_what_any_template_makes():
    turns = [("user", "hi"), ("assistant", "aa"), ("assistant", ""), ("user", "b")]
    got = chat_format.render(bracketed, turns)
    assert got.text == bracketed(turns) and got.rewritten is None
    assert "".join(got.text[a:b] for a, b in got.turns) == got.text
    assert [got.text[a:b] for a, b in got.losses] == ["aa", ""]


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "x"), ("assistant", "think~yes"), ("user", "z"), ("assistant", "no")]
    assert chat_format.render(forgetful, turns).rewritten == 2
    assert chat_format.render(forgetful, turns).losses == []
    assert chat_format.render(closing, turns).rewritten == 1
    assert chat_format.render(lambda t: "".join(f"<{x.strip()}>" for _, x in t), [("assistant", " a ")]).losses == [(1, 2)]
    assert chat_format.render(lambda t: "".join(f"<{x}>" if x else "-" for _, x in t), [("user", ""), ("assistant", "")]).rewritten == 1


def plain_digest(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0], t[1].encode(), t[2].encode()))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        formatted = chat_format.MarkedTurns()([(r, t) for _, r, t in turns])
        out[conv] = (len(turns), sha(*[f"{r}\n{t}\n" for _, r, t in turns]), len(loss), sha(loss), len(formatted))
    return out


def chats(spark, rows, **options):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("_g", "_i", "part", "_own", "conv")})
    return chat_format.format_chats(turns, **options)


def test_digests_are_those_of_the_rows(spark):
    draw = random.Random(5)
    rows = [(c if c else None, t if t != 3 else None, draw.choice(["user", "assistant", "system", None, "a:b"]), draw.choice([None, "", "x" * t, "</turn>\n### é", "\\"])) for c in range(20) for t in range(draw.randint(1, 9))]
    rows += [(5, 1, "assistant", "twice")] * 2
    got = {r[0]: tuple(r)[1:] for r in chat_format.read_back(chats(spark, rows)).collect()}
    assert got == plain_digest(rows)
    assert chat_format.read_back(chats(spark, [])).count() == 0


def test_long_conversations_are_cut_into_parts_and_read_the_same(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} " + "y" * (t % 7)) for t in range(500)] + [(2, t, "user", "short") for t in range(3)]
    rows += [(None, 4, "assistant", "same")] * 100
    formatted = chats(spark, rows, part_turns=32, context_turns=2)
    parts = {(r.conv_id, r.part): r for r in formatted.collect()}
    assert {k: sum(c == k for c, _ in parts) for k in (1, 2, None)} == {1: 16, 2: 1, None: 4}
    whole = "".join(parts[1, k].formatted for k in range(16))
    assert whole == chat_format.MarkedTurns()([(r, t) for c, _, r, t in rows if c == 1])
    got = {r[0]: tuple(r)[1:] for r in chat_format.read_back(formatted).collect()}
    assert got == plain_digest(rows)


def test_rewriting_is_told_for_each_conversation(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "hm~b"), (2, 2, "user", "c")]
    last = lambda turns: "".join(f"{role}|{text if k == len(turns) - 1 else text.split('~')[-1]}\n" for k, (role, text) in enumerate(turns))
    got = {r.conv_id: (r.rewritten, len(r.turns), len(r.losses)) for r in chats(spark, rows, template=last).collect()}
    assert got == {1: (None, 2, 1), 2: (2, 0, 0)}


# Spelling


def plain_near(words: dict[str, int]) -> dict[str, set[str]]:
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= {w[:i] + w[i + 1 :]} & words.keys()
    for w in words:
        for x in list(near[w]):
            near[x].add(w)
    for a in words:
        for b in words:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
    return near


def plain_variants(words: dict[str, int]) -> dict[str, tuple]:
    near, forms = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def drawn(seed: int, many: int, letters: str = "abcé", sizes=(5, 9)) -> dict[str, int]:
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(*sizes))): draw.choice([1, 2, 15, 170, 2000, 50_000]) for _ in range(many)}
    for w in list(words)[: many // 3]:
        at = draw.randrange(len(w))
        words[w[:at] + draw.choice(letters) + w[at + draw.randint(0, 1) :]] = draw.choice([1, 3, 40])
    return words


def table(spark, words: dict[str, int]):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("seed, limit", [(1, None), (2, 5), (3, 40)])
def test_variants_are_those_of_all_pairs(spark, seed, limit):
    words = drawn(seed, 250)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(table(spark, words), shard_words=limit).collect()}
    assert got == plain_variants(words)
    assert any(x[0] for x in got.values()) and any(x[0] != x[1] for x in got.values() if x[0])


def test_many_words_of_the_same_letters(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LARGE_LEAF", 3)
    words = {"".join(random.Random(k).sample("aabbccdd", 8)): k + 1 for k in range(300)} | {"aabbccdde": 4, "aabbccd": 9, "aabbcxcdd": 2, "xyzxyzaa": 7, "wyzxyzaa": 8}
    letters = spelling.Letters([ord(c) for c in "abcdexyzw"], alone=3, shared=2)
    trie, told = spelling.Trie(letters, list(words)), list(words)
    pairs = Counter()
    for i, k in trie.search(spelling.Words(told)):
        pairs.update(frozenset((told[x], trie.words.words[y])) for x, y in zip(i, k, strict=True))
    want = {frozenset((a, b)) for a, others in plain_near(words).items() for b in others}
    assert set(pairs) == want and set(pairs.values()) == {1}


def test_one_apart_compares_whole_words():
    long = "a" * 5000
    a, b = spelling.Words(["abc", "abc", "abc", "abc", "aab", long, "é"]), spelling.Words(["abd", "abcd", "abc", "bbd", "aaab", long[:2500] + "b" + long[2500:], "ê"])
    at = np.arange(7)
    assert spelling.one_apart(a, at, b, at).tolist() == [True, True, False, False, True, True, True]


def test_words_empty_null_and_counted(spark):
    docs = spark.createDataFrame([(1, "Résumés résumés RÉSUMÉS ab"), (2, None), (3, ""), (None, "résumés x" * 2), (4, "z" * 30_000 + " " + "z" * 30_000)], "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("word", F.lit(1))
    counted = {r.word: r.n for r in spelling.count_words(spelling.runs(docs).select(F.col("run").alias("word"))).collect()}
    assert counted == {"résumés": 3, "z" * 30_000: 2} | ({"rÉsumÉs": 2} if counted.get("rÉsumÉs") == 2 else {})
    none = spelling.group_variants(spark.createDataFrame([], "word string, n long"))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_queries_equal_their_sql(spark, tmp_path):
    draw = random.Random(3)
    words = ["houseboat", "housebot", "Houseboat", "lighthouse", "lighthous", "straßenbahn", "strassenbahn"]
    docs = [(i, f"s{i % 3}", ["en", None, "de"][i % 3], i, None if i % 17 == 0 else " ".join(draw.choice(words) for _ in range(60))) for i in range(80)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "a#"), (1, 1, "assistant", None), (2, 0, None, "x</turn>")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for module in (merkle, chat_format, spelling):
        got, want = module.query(spark, str(tmp_path)), db.sql(module.ORACLE_SQL)
        assert sorted(got.columns) == sorted(want.columns)
        rows = want.select(", ".join(got.columns)).fetchall()
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, rows)), module.__name__
