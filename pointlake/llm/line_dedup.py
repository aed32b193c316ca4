"""Line dedup by an exact set-similarity join, in DataFrame operations only.

The tokens of a line are its distinct five-word shingles (lower-cased words between spaces; a shorter line is one
token). Lines whose lower-cased texts are equal form one class, which stands at its first occurrence. A class goes if
an earlier class is similar to it (Jaccard 0.75 or more); then the later occurrences of all classes go as well.

For any one order of tokens, similar lines share a token in the first quarter of both (prefix filter). It is used twice:

* With tokens in the order of their hashes, prefixes need no knowledge of the corpus. Tokens that stand in prefixes of at
  most ``HOT`` classes give pairs at once, by length, position and the number of shared prefix tokens.
* Classes that have a token in common with more others than that are hot. A pair that isn't found through a token of
  few classes shares one of many, so both of its classes are hot. The tokens of hot classes are counted, and ordered by rarity:
  tokens of a passage that many lines hold then stand last, and a class whose tokens are mostly its own drops out. Tokens
  of one class alone match nothing, so classes of as many tokens that share the same ones with others (lines of one
  template, each with words of its own) are alike to all the rest: they form one group, which stands at its first
  class. A group is compared first with the earliest group of each prefix token (one pair a row, however many groups
  share it), and what finds no match there with all groups of its tokens, behind the length and positional filters
  and an upper bound of the overlap from 512-bit maps of the token sets. A class goes if a group similar to its own
  stands before it, its own if that one's classes are similar to each other.

Jaccard is then taken on the full sets. ``HOT`` decides the way, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard, fresh

WORDS = 5
PERCENT = 75
HOT = 64
MAPS = 8


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line, the lower-cased text s and its two hashes ka and kb, of every line that has words."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.lower(F.col(text_col)), "\n")).alias("line", "s"))
    return lines.where("doc is not null and trim(s) <> ''").select("doc", "line", "s", F.xxhash64("s").alias("ka"), F.xxhash64(F.lit(1), "s").alias("kb"))


def _with_keys(lines: DataFrame) -> DataFrame:
    """``lines`` with keys, the sorted distinct token hashes, in place of the text s."""
    words, plain = F.split("s", " "), ~(F.col("s").contains("  ") | F.col("s").startswith(" ") | F.col("s").endswith(" "))
    hashed = F.transform(F.when(plain, words).otherwise(F.filter(words, lambda w: w != "")), lambda w: F.xxhash64(w))

    def token(w: Column, i: Column) -> Column:
        return F.xxhash64(w, *[F.get("w", i + j) for j in range(1, WORDS)])

    keys = F.array_distinct(F.slice(F.transform("w", token), F.lit(1), F.greatest(F.lit(1), F.size("w") - (WORDS - 1))))
    rest = [c for c in lines.columns if c != "s"]
    return lines.select(*rest, hashed.alias("w")).select(*rest, F.sort_array(keys).alias("keys"))


class _Numbers:
    """One number for a document and a line, in their order: a long where it fits, else a decimal."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        doc = F.col(id_col).cast("long")
        low, high = docs.agg(F.min(doc), F.max(doc)).first()
        self.low, self.step = low or 0, 1 << 31  # lines are fewer in any case; where ids lie far apart, they are counted
        span = (high or 0) - self.low + 1
        if span * self.step >= 1 << 62:
            self.step = 1 << docs.agg(F.max(F.size(F.split(F.coalesce(text_col, F.lit("")), "\n")))).first()[0].bit_length()
        self.type = "bigint" if span * self.step < 1 << 62 else "decimal(38,0)"

    def id(self) -> Column:
        wide = "bigint" if self.type == "bigint" else "decimal(19,0)"
        doc = F.col("doc").cast(wide) - F.lit(self.low).cast(wide)
        return (doc * F.lit(self.step).cast(wide)).cast(self.type) + F.col("line").cast(self.type)

    def doc(self) -> Column:
        return (F.expr(f"id div {self.step}") + F.lit(self.low)).cast("bigint")

    def line(self) -> Column:
        return F.expr(f"cast(id % {self.step} as int)")


_LEAST = f"(({PERCENT} * {{0}} + 99) div 100)"  # of a line's tokens, a similar line has so many at least
_LENGTH = f"100 * least(x_n, y_n) >= {PERCENT} * greatest(x_n, y_n)"
_PLACE = f"(100 + {PERCENT}) * (least(x_pos, y_pos) + least(x_n - x_pos, y_n - y_pos)) >= {PERCENT} * (x_n + y_n)"
_PLACE_SHARED = f"(100 + {PERCENT}) * (least(x_at, y_at) + least(x_m - x_at, y_m - y_at)) >= {PERCENT} * (x_n + y_n)"
_ALIKE = f"100 * m >= {PERCENT} * (2 * n - m)"  # classes of n tokens that share just the same m of them
SALTS = 16


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, numbers: _Numbers) -> DataFrame:
    """``wanted`` with the text s of each line (id), if it has words. Only the lines that are asked for leave their documents."""
    of = wanted.select(numbers.doc().alias("doc"), F.struct(numbers.line().alias("line"), *wanted.columns).alias("at")).groupBy("doc").agg(F.collect_set("at").alias("some"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(of.hint("shuffle_hash"), "doc")

    def told(of: Column) -> Column:
        return F.transform(of["some"], lambda at: F.struct(*[at[c].alias(c) for c in wanted.columns], F.get(of["parts"], at["line"]).alias("s")))

    found = F.transform(F.array(F.struct(F.split(F.lower("text"), "\n").alias("parts"), "some")), told)[0]  # so that the text is split once
    return texts.select(F.explode(found).alias("at")).select("at.*").where("trim(s) <> ''")


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "token"])


def _similar(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Of pairs (grouped, x_id, y_id): grouped, id and the least y_id (before) of each x_id whose full token set is similar."""
    x, y = (sets.select(F.col("id").alias(f"{p}_id"), F.col("keys").alias(f"{p}_keys")) for p in "xy")
    met = pairs.join(y, "y_id").join(x, "x_id")
    met = met.where(f"(100 + {PERCENT}) * size(array_intersect(x_keys, y_keys)) >= {PERCENT} * (size(x_keys) + size(y_keys))")
    return cut(met.groupBy("grouped", F.col("x_id").alias("id")).agg(F.min("y_id").alias("before")), name)


def _pairs_of_few(shared: DataFrame, hot: DataFrame) -> DataFrame:
    """(x_id, y_id): pairs that share prefix tokens of few classes, y being the earlier, unless both are hot."""
    few = shared.where(F.col("times") <= HOT).join(hot.withColumn("hot", F.lit(True)), "id", "left")
    few = few.select("token", "id", "n", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))
    met = _side(few, "x").join(_side(few, "y"), "token").where(f"y_id < x_id and not (x_hot and y_hot) and {_LENGTH} and {_PLACE}")
    # what two lines have in common is in both prefixes, or after the prefix of one and after the last common token of the other
    after = f"greatest(least({_LEAST.format('x_n')} - 1, y_n - 1 - y_last), least({_LEAST.format('y_n')} - 1, x_n - 1 - x_last))"
    enough = f"(100 + {PERCENT}) * (c + {after}) >= {PERCENT} * (x_n + y_n)"
    met = met.groupBy("x_id", "y_id", "x_n", "y_n").agg(F.count("*").alias("c"), F.max("x_pos").alias("x_last"), F.max("y_pos").alias("y_last"))
    return met.where(enough).select("x_id", "y_id")


def _rare_prefixes(sets: DataFrame, parts: int) -> DataFrame:
    """id, n, m (tokens that another class has), two hashes ha and hb and maps b0 .. b7 of these, and the prefix in the order of rarity, of hot classes.

    A class whose shared tokens are fewer than a similar class needs has no row.
    """
    tokens = sets.where("hot").select("id", F.size("keys").alias("n"), F.explode("keys").alias("token")).repartition(parts, "token")
    shared = tokens.withColumn("times", F.count("*").over(Window.partitionBy("token"))).where("times > 1")
    of = shared.groupBy("id", "n").agg(F.collect_list(F.struct("times", "token")).alias("all"))
    of = of.withColumn("need", F.expr(_LEAST.format("n")).cast("int")).where("size(all) >= need").withColumn("m", F.size("all"))

    def bits(k: int) -> Column:
        here = lambda t: F.shiftright(t["token"], 6).bitwiseAND(F.lit(MAPS - 1)) == k
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), t["token"].bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate("all", F.lit(0).cast("bigint"), lambda found, t: F.when(here(t), found.bitwiseOR(bit(t))).otherwise(found)).alias(f"b{k}")

    maps = [f"b{k}" for k in range(MAPS)]
    of = of.withColumn("all", F.array_sort("all"))
    hashes = [F.xxhash64(F.col("all")["token"]).alias("ha"), F.xxhash64(F.lit(1), F.col("all")["token"]).alias("hb")]
    return of.select("id", "n", "m", *hashes, *[bits(k) for k in range(MAPS)], F.slice("all", F.lit(1), F.col("m") - F.col("need") + 1)["token"].alias("prefix"))


def _groups(classes: DataFrame) -> DataFrame:
    """token, its place ``at`` among the shared ones, id and last (first and last class), n, m and maps of groups of classes that share the same tokens."""
    maps = [f"b{k}" for k in range(MAPS)]
    of = classes.groupBy("n", "m", "ha", "hb", *maps, "prefix").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    return of.select("id", "last", "n", "m", *maps, F.posexplode("prefix").alias("at", "token"))


def _later(classes: DataFrame, before: DataFrame) -> DataFrame:
    """The classes (id) of those groups (id, before) that come after ``before``. A group may hold most classes, so it is salted."""
    same = ["n", "ha", "hb", "salt"]
    at = before.join(classes.select("id", "n", "ha", "hb"), "id").select("n", "ha", "hb", "before", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = classes.select("id", "n", "ha", "hb", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(at, same)
    return met.where("id > before").select("id")


def _overlap() -> str:
    """Whether the maps leave room for similarity: a bit that one has and the other hasn't is a token not shared."""
    lone = lambda a, b: " + ".join(f"bit_count({a}_b{k} & ~{b}_b{k})" for k in range(MAPS))
    return f"(100 + {PERCENT}) * least(x_m - ({lone('x', 'y')}), y_m - ({lone('y', 'x')})) >= {PERCENT} * (x_n + y_n)"


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line): the lines to remove. A line number counts from 0.

    Lines without words are never removed. Null texts and rows without an id have no lines here. Rows that
    repeat an id are taken as one document: a line number that goes in one of them goes in all.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = _Numbers(docs, id_col, text_col)
    lines = cut(_lines(docs, id_col, text_col).select(numbers.id().alias("id"), "ka", "kb"), "lines")
    classes = cut(lines.groupBy("ka", "kb").agg(F.min("id").alias("first"), F.count("*").alias("times")), "classes")
    copies = cut(lines.join(classes.where("times > 1").select("ka", "kb", "first"), ["ka", "kb"]).where("id <> first").select("id").distinct(), "copies")
    discard(lines)

    head = F.expr(f"slice(keys, 1, cast(size(keys) - {_LEAST.format('size(keys)')} + 1 as int))")
    keys = _with_keys(_texts(docs, id_col, text_col, classes.select(F.col("first").alias("id")), numbers))
    # exploded as an expression: of a column Spark would infer a filter, and hash all tokens once more for it
    tokens = keys.select("id", F.size("keys").cast("bigint").alias("n"), F.posexplode(head).alias("pos", "token"))
    tokens = tokens.select("token", "id", F.expr("shiftleft(n, 32) | pos").alias("at")).repartition(parts, "token")
    shared = tokens.withColumn("times", F.count("*").over(Window.partitionBy("token"))).where("times > 1")
    shared = cut(shared.select("token", "id", F.expr("cast(shiftright(at, 32) as int)").alias("n"), F.expr("cast(at & 4294967295 as int)").alias("pos"), "times"), "shared")
    discard(classes)

    hot = cut(shared.where(F.col("times") > HOT).select("id").distinct(), "hot")
    few = cut(_pairs_of_few(shared, hot), "few-pairs")
    discard(shared)

    ids = few.select(F.col("x_id").alias("id")).unionByName(few.select(F.col("y_id").alias("id"))).withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True)))
    wanted = ids.groupBy("id").agg(F.max("hot").alias("hot"))
    sets = cut(_with_keys(_texts(docs, id_col, text_col, wanted, numbers)), "sets")

    classes = cut(_rare_prefixes(sets, parts), "prefixes")
    rare = cut(_groups(classes), "rare")
    least = _side(rare.groupBy("token").agg(F.min(F.struct("id", "n", "m", "at", *[f"b{k}" for k in range(MAPS)])).alias("m")).select("token", "m.*"), "y")
    near = f"y_id < x_last and y_id <> x_id and {_LENGTH} and {_PLACE_SHARED} and {_overlap()}"
    pair = [F.lit(True).alias("grouped"), "x_id", "y_id"]
    star = _side(rare, "x").join(least, "token").where(near).select(*pair).distinct()
    found = _similar(star.unionByName(few.distinct().withColumn("grouped", F.lit(False))), sets, "found")
    done = found.withColumnRenamed("id", "done_id")
    open_ = rare.join(done, F.expr("id = done_id and (grouped and before < id or not grouped and last = id)"), "left_anti")
    rest = _similar(_side(open_, "x").join(_side(rare, "y"), "token").where(near).select(*pair).distinct(), sets, "rest")
    alike = rare.where(f"at = 0 and last > id and {_ALIKE}").select("id", F.col("id").alias("before"))
    before = found.where("grouped").select("id", "before").unionByName(rest.select("id", "before")).unionByName(alike).groupBy("id").agg(F.min("before").alias("before"))
    gone = found.where("not grouped").select("id").unionByName(_later(classes, before)).unionByName(copies).distinct()
    out = cut(gone.select(numbers.doc().alias("doc"), numbers.line().alias("line")), "removed-lines")
    for table in (copies, hot, few, sets, classes, rare, found, rest):
        discard(table)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with later copies and near-copies of lines taken out of the text; every row and column stays.

    The lines left are joined as they stood; null texts stay null, and a document may become empty. A very long text is
    one row here, its lines are rows of their own in the join. Of equal lines the first in the order of (id, line) stays.
    ``count_col`` names a column for the number of lines removed (an input column of that name is replaced); other
    columns may have any names.
    """
    key, gone = fresh(docs, "doc"), fresh(docs, "gone")
    per_doc = removed_lines(docs, id_col, text_col).groupBy(F.col("doc").alias(key)).agg(F.sort_array(F.collect_set("line")).alias(gone))
    met = docs.join(per_doc.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(key), "left")
    parts = F.split(F.col(text_col), "\n")
    edges = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(parts)))

    def between(of: Column) -> Column:
        """The lines between one removed line and the next, for all of them."""
        edge = lambda k: F.get(of["edges"], k)
        runs = F.transform(F.sequence(F.lit(1), F.size(of["edges"]) - 1), lambda k: F.slice(of["parts"], edge(k - 1) + 2, F.greatest(F.lit(0), edge(k) - edge(k - 1) - 1)))
        return F.array_join(F.flatten(runs), "\n")

    left = F.transform(F.array(F.struct(parts.alias("parts"), edges.alias("edges"))), between)[0]  # so that the text is split once
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)
    count = [F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(count_col)] if count_col else []
    return met.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col], *count)
