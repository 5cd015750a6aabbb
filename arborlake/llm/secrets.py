"""Secret scan: candidates by pattern, and a random forest that removes false positives.

Candidates are long runs of key characters, and values of any length and characters behind a secret's name and an assignment. The forest sees their length, how their characters' classes follow each other,
how much of them dictionary words cover, the path they are in, and the words beside them; it is fitted on a bounded sample of labelled findings, and
its trees are written out as SQL expressions, so that the scan is one map of built-in functions over the texts, without any shuffle.

Where no findings were labelled by hand, the forest is made of two halves that teach each other: half of the trees see only the finding itself and learn from labels of its context,
the other half see only path and neighbours and learn from what the finding is made of (known formats, mixed characters, plain numbers and words). No tree
sees what its labels were made from, and a finding's score is that of the half that doubts it more. Every pattern is bounded, so the work on a text grows with its length.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, read_table, stored, text_of

CANDIDATE = r"[A-Za-z0-9_+/=\-]{16,}"
#: What words beside a candidate say for and against a secret, and parts of paths that hold examples.
FOR = ("token", "key", "apikey", "api", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "private")
AGAINST = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "id", "ref", "example", "sample", "placeholder", "dummy")
EXAMPLES = ("test", "tests", "example", "examples", "sample", "fixture", "fixtures", "doc", "docs", "mock")
#: A secret's name, also as a later part of snake_case or camelCase; an assignment; and the quote that may open a value.
_NAME = rf"(?:(?:^|[^A-Za-z0-9])(?i:{'|'.join(FOR)})|(?<=[a-z0-9])(?:{'|'.join(w.capitalize() for w in FOR)}))(?![a-z])[A-Za-z0-9_.\-]{{0,64}}+"
_SIGN, _QUOTE = r"[\"'\])]{0,4}+(?::=|=>|[:=]{1,3})", "[\"'`]"
#: A quoted value ends within so many words, or with its first one.
QUOTED_WORDS = 64
#: Published formats of keys, and of what is none.
KNOWN = r"^(AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z\-]{10,}|sk_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_\-]+)$"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
_CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "other": "[^a-zA-Z0-9]"}
NEIGHBOURS = ("before2", "before", "prefix", "after")


def _opening(w: Column, before: Column, before2: Column) -> Column:
    """What precedes the value in w if w holds one, or its start, behind a secret's name and an assignment, all in w or in up to two words before; else null."""
    own = F.when(w.rlike("[:=]"), F.regexp_extract(w, rf"^(.*{_NAME}{_SIGN}{_QUOTE}?)[^\"'`]", 1))
    behind = F.when(before.rlike("[:=>]$") & (before.rlike(rf"{_NAME}{_SIGN}$") | (before.rlike(rf"^{_SIGN}$") & before2.rlike(rf"{_NAME}[\"'\])]*$"))), F.regexp_extract(w, f"^{_QUOTE}?", 0))
    joined = F.when(w.rlike("^[:=]") & before.rlike(rf"{_NAME}[\"'\])]*$"), F.regexp_extract(w, rf"^({_SIGN}{_QUOTE}?)[^\"'`]", 1))
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(own), filled(joined), behind)


def _value(words: Column, s: Column) -> Column:
    """The value behind s.opening: to the closing quote, which may stand in a later word (white space then is one blank each), or to the word's end."""
    rest, quote = F.substring(s.word, F.length(s.opening) + 1, F.length(s.word)), F.regexp_extract(s.opening, f"{_QUOTE}$", 0)
    more = F.array_join(F.slice(words, s.word_no + 2, QUOTED_WORDS), " ")
    here, later = F.instr(rest, quote), F.instr(more, quote)
    whole = F.when(here > 0, F.substring(rest, F.lit(1), here - 1)).when(later > 0, F.concat(rest, F.lit(" "), F.substring(more, F.lit(1), later - 1))).otherwise(rest)
    return F.when(quote == "", F.regexp_replace(rest, "[,;]+$", "")).otherwise(whole)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, path, word_no, part_no, finding, and its neighbours before2, before, prefix (what precedes it in its own word), suffix, after.

    A word's runs of 16 key characters or more come first, then the value that starts in it behind a secret's name and an assignment, unless it is one of them; a quoted value
    may go over several words, QUOTED_WORDS at most. Words are split at white space; prefix and suffix of a run reach to the runs beside it. Null and empty texts have no candidate; a null
    path is empty; null ids are carried, repeated rows each give theirs, and other columns are ignored, whatever their names. Texts, words and findings may be very long: the work
    grows with their length. An empty table gives no rows.
    """
    path = F.coalesce(quoted(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    worth = F.col("text").rlike(CANDIDATE) | (F.col("text").rlike("[:=]") & F.col("text").rlike(f"(?i){'|'.join(FOR)}"))
    rows = docs.select(quoted(id_col).alias("doc_id"), path.alias("path"), text_of(quoted(text_col)).alias("text")).filter(worth)
    words = rows.select("doc_id", "path", F.split("text", r"\s+").alias("words"))
    beside = lambda i, k: F.coalesce(F.get(F.col("words"), i + F.lit(k)), F.lit(""))
    found = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("word_no"), w.alias("word"), beside(i, -2).alias("before2"), beside(i, -1).alias("before"), beside(i, 1).alias("after"), _opening(w, beside(i, -1), beside(i, -2)).alias("opening"))),
        lambda s: s.opening.isNotNull() | s.word.rlike(CANDIDATE),
    )
    each = words.select("doc_id", "path", "words", found.alias("found"))
    each = each.select("doc_id", "path", F.explode(F.transform("found", lambda s: F.struct(s.alias("s"), _value(F.col("words"), s).alias("value")))).alias("w")).select("doc_id", "path", "w.s.*", "w.value")
    # runs between marks: every second piece; a mark in the text itself is another sign
    each = each.withColumn("pieces", F.split(F.regexp_replace(F.translate("word", "\x01", "\x02"), f"({CANDIDATE})", "\x01$1\x01"), "\x01"))
    part = lambda finding, prefix, suffix: F.struct(finding.alias("finding"), prefix.alias("prefix"), suffix.alias("suffix"))
    none = F.array().cast("array<struct<finding:string,prefix:string,suffix:string>>")
    at = lambda i: F.get(F.col("pieces"), i)
    runs = F.when(F.size("pieces") > 1, F.transform(F.sequence(F.lit(1), F.size("pieces") - 2, F.lit(2)), lambda i: part(at(i), at(i - 1), at(i + 1)))).otherwise(none)
    behind = F.substring("word", F.length("opening") + F.length("value") + 1, F.length("word"))
    value = F.when((F.col("value") != "") & ~F.exists("runs", lambda r: r.finding == F.col("value")), F.array(part(F.col("value"), F.col("opening"), behind))).otherwise(none)
    each = each.withColumn("runs", runs)
    each = each.select("doc_id", "path", "word_no", "before2", "before", "after", F.posexplode(F.concat("runs", value)).alias("part_no", "part"))
    return each.select("doc_id", "path", "word_no", "part_no", "part.finding", "before2", "before", "part.prefix", "part.suffix", "after")


def _any_of(words: list[str]) -> str:
    """A pattern of any of the words, the longest first: their common beginnings are tried once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        several = [re.escape(c) + pattern(node[c]) for c in sorted(node) if c]
        inner = several[0] if len(several) == 1 and "" not in node else f"(?:{'|'.join(several)})" if several else ""
        return inner + "?" if several and "" in node else inner

    return pattern(tree)


def features(dictionary: list[str]) -> dict[str, Column]:
    """Of a row of candidates(); dictionary is a stated list of words."""
    f, n = F.col("finding"), F.length("finding")
    out = {"length": n}
    for a, x in _CLASSES.items():
        for b, y in _CLASSES.items():
            out[f"step_{a}_{b}"] = F.regexp_count(f, F.lit(f"{x}(?={y})")) / F.greatest(n - 1, F.lit(1))
    known = _any_of(sorted({w.lower() for w in dictionary if len(w) > 2}))
    out["covered"] = 1 - F.length(F.regexp_replace(F.lower(f), known, "")) / n if known else F.lit(0.0)
    parts = F.split(F.lower("path"), r"[^a-z0-9]+")
    out["path_example"] = F.arrays_overlap(parts, F.array(*map(F.lit, EXAMPLES))).cast("int")
    out["path_depth"] = F.regexp_count("path", F.lit("/"))
    out["path_suffix"] = F.pmod(F.crc32(F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1).cast("binary")), F.lit(16))
    for side in NEIGHBOURS:
        bare = F.split(F.lower(side), r"[^a-z0-9]+")
        out[f"{side}_for"] = F.arrays_overlap(bare, F.array(*map(F.lit, FOR))).cast("int")
        out[f"{side}_against"] = F.arrays_overlap(bare, F.array(*map(F.lit, AGAINST))).cast("int")
        out[f"{side}_length"] = F.length(side)
    out["assigned"] = F.concat("before", F.lit(" "), "prefix").rlike(r"[:=]['\"\s]*$").cast("int")
    out["quoted"] = F.col("prefix").rlike(r"['\"]$").cast("int")
    return {k: v.cast("double") for k, v in out.items()}


#: Features of the finding itself; all others are of its context.
OWN = ("length", "step_", "covered")


def described(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Rows of candidates() with their features, f_..., and without any clear text: length and finding_sha256 stand for the finding."""
    if "finding" not in found.columns:
        return found
    others = [c for c in found.columns if c not in ("finding", "path", "prefix", "suffix", "before", "before2", "after")]
    return found.select(*others, F.length("finding").alias("length"), F.sha2("finding", 256).alias("finding_sha256"), *(v.alias(f"f_{k}") for k, v in features(dictionary).items()))


def _nodes(node, names: list[str]):
    """A tree as (feature, threshold, left, right), or the positive share at a leaf."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return float(stats[1] / sum(stats)) if sum(stats) and len(stats) > 1 else 0.0
    split = node.split()
    return names[split.featureIndex()], float(split.threshold()), _nodes(node.leftChild(), names), _nodes(node.rightChild(), names)


def _tree_sql(node) -> str:
    if isinstance(node, float):
        return f"{node!r}D"
    name, threshold, left, right = node
    return f"CASE WHEN {name} <= {threshold!r}D THEN {_tree_sql(left)} ELSE {_tree_sql(right)} END"


class Forest:
    """A fitted forest: its score is the mean of its trees' leaves, and of several parts the least mean, in SQL over the feature columns."""

    def __init__(self, dictionary: list[str], parts: list[list], constant: float = 1.0):
        self.dictionary, self.parts, self.constant = dictionary, [p for p in parts if p], constant

    trees = property(lambda self: [t for p in self.parts for t in p])

    def score(self, rows: DataFrame) -> DataFrame:
        rows = described(rows, self.dictionary)
        means = [F.expr(f"({' + '.join(f'({_tree_sql(t)})' for t in p)}) / {float(len(p))}D") for p in self.parts]
        score = F.least(*means) if len(means) > 1 else means[0] if means else F.lit(float(self.constant))
        return rows.select(*(c for c in rows.columns if not c.startswith("f_")), score.alias("score"))

    def __and__(self, other: Forest) -> Forest:
        """Both must take a finding for a secret; of two without trees, both constants."""
        return Forest(self.dictionary, self.parts + other.parts, min(self.constant, other.constant))


def fit(labelled: DataFrame, dictionary: list[str], most: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 13, see=lambda name: True, label: str = "label") -> Forest:
    """From about most labelled findings: rows of candidates(), or of described(), with label 0 or 1, chosen by hash. Trees see the features whose names see() takes.

    Null labels are passed over; findings of one label only give that label as every score, none keep all. Rows that repeat are chosen all or none.
    """
    rows = described(labelled.filter(F.col(label).isNotNull()), dictionary).withColumn("label", F.col(label))
    sizes = {r["label"]: r["n"] for r in rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if set(sizes) != {0, 1}:
        return Forest(dictionary, [], float(next(iter(sizes), 1)))
    million, share = 1_000_000, F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, int(million * min(1, most / 2 / n))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "word_no", "part_no"), F.lit(million)) < share)
    names = [c for c in rows.columns if c.startswith("f_") and see(c[2:])]
    points = VectorAssembler(inputCols=names, outputCol="features").transform(sample.select(F.col("label").cast("double").alias("label"), *names)).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", featureSubsetStrategy="sqrt").fit(points)
    return Forest(dictionary, [[_nodes(t._java_obj.rootNode(), names) for t in model.trees]])


def fit_halves(found: DataFrame, dictionary: list[str], most: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 13) -> Forest:
    """A forest of two halves, from rows with by_context and by_evidence: what the finding is judges its context, and its context judges what it is. Rows whose labels contradict each
    other teach neither half, and a half whose labels are all alike has no trees."""
    found = found.filter(F.coalesce(F.col("by_context") == F.col("by_evidence"), F.lit(True)))
    own = fit(found, dictionary, most, trees // 2, depth, seed, lambda name: name.startswith(OWN), "by_context")
    beside = fit(found, dictionary, most, trees - trees // 2, depth, seed, lambda name: not name.startswith(OWN), "by_evidence")
    return own & beside


def judged(found: DataFrame, forest: Forest, min_score: float = 0.5) -> DataFrame:
    """Rows of candidates(), or of described(), without clear text, with score, 0 to 1, and kept: whether the forest takes the finding for a secret."""
    return forest.score(found).withColumn("kept", F.col("score") >= min_score)


def scan(docs: DataFrame, forest: Forest, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """judged() of all candidates() of docs; nulls, repeated rows, long texts, empty tables and other columns as there."""
    return judged(candidates(docs, id_col, text_col, path_col), forest, min_score)


def by_context() -> Column:
    """A label of a row of candidates() from its neighbours: 1 if a word for secrets and a sign of assignment precede, 0 if neither does or a word for other things stands beside it; null, and so unused, else."""
    words = lambda *c: F.split(F.lower(F.concat_ws(" ", *c)), r"[^a-z0-9]+")
    named = F.arrays_overlap(words("before2", "before", "prefix"), F.array(*map(F.lit, FOR)))
    other = F.arrays_overlap(words("before", "prefix", "after"), F.array(*map(F.lit, AGAINST)))
    assigned = F.concat("before", F.lit(" "), "prefix").rlike(r"[:=]['\"\s]*$")
    return F.when(named & assigned & ~other, 1).when(other | (~named & ~assigned), 0)


def by_evidence() -> Column:
    """A label of a row of candidates() from what the finding is made of: 1 for known formats, and 20 characters or more with letters, digits and at least ten different signs; 0 for UUIDs, numbers, words in one
    case, and what has few different signs; null, and so unused, else and for findings over 256 characters."""
    f = F.when(F.length("finding") <= 256, F.col("finding"))
    signs = F.size(F.array_distinct(F.split(f, "")))
    mixed = f.rlike("[0-9]") & f.rlike("[A-Za-z]")
    plain = f.rlike(UUID) | f.rlike(r"^[0-9]+$") | (f.rlike(r"^([a-z]+|[A-Z]+|[A-Z][a-z]+)$")) | (signs <= 4)
    return F.when(f.rlike(KNOWN), 1).when(plain, 0).when(mixed & (F.length(f) >= 20) & (signs >= 10), 1)


def label_by_context(found: DataFrame) -> DataFrame:
    """found with by_context() as label; a forest that learns from it should not see the context."""
    return found.withColumn("label", by_context())


def common_words(texts: DataFrame, text_col: str = "text", most: int = 2000) -> list[str]:
    """The most frequent words of 4 letters or more of a table, counted over all of it, ties by word; at most so many."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text_of(quoted(text_col))), F.lit(r"[\p{L}]{4,}"), F.lit(0))).alias("w"))
    return [r["w"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()]


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of documents, judged by a forest of two halves; what is written on the way has features, labels and hashes, but no finding."""
    docs = read_table(spark, sf_dir, "documents")
    dictionary = common_words(docs)
    found = candidates(docs).withColumns({"by_context": by_context(), "by_evidence": by_evidence()})
    rows, _ = stored(described(found, dictionary), "findings")
    out = judged(rows, fit_halves(rows, dictionary))
    return out.select("doc_id", "word_no", "part_no", "length", "finding_sha256", F.round("score", 9).alias("score"), "kept")
