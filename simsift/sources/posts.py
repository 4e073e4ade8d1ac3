"""Forum posts: the XML scan, ordinals and ranges, answers, and the word streams."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored

# Attributes of a row and the columns they become.
ATTRIBUTES = {
    "_Id": "id", "_PostTypeId": "post_type", "_ParentId": "parent_id", "_AcceptedAnswerId": "accepted_answer_id", "_CreationDate": "creation_date",
    "_Score": "score", "_ViewCount": "view_count", "_Body": "body", "_Tags": "tags", "_AnswerCount": "answer_count", "_CommentCount": "comment_count",
    "_FavoriteCount": "favorite_count", "_Title": "title",
}
COMMENT_ATTRIBUTES = {"_Id": "id", "_PostId": "post_id", "_Score": "score", "_Text": "text", "_CreationDate": "creation_date"}
NUMBERS = ("id", "parent_id", "accepted_answer_id", "score", "view_count", "answer_count", "comment_count", "favorite_count")
#: The rest of a start tag behind its name: attributes, and a slash where the element ends at once.
START_TAG = r"""^((?:[\s/](?:[^<>"']|"[^"]*"|'[^']*')*)?)>"""
#: Rows that one partition puts in order.
ORDERED = 20_000


def _attribute(name: str, value: str) -> str:
    """A pattern of a start tag that has the attribute; values that need escapes are left to the reader."""
    return rf"""\s{re.escape(name)}\s*=\s*("{re.escape(value)}"|'{re.escape(value)}')"""


def _rows(spark: SparkSession, path: str, attributes: dict[str, str], only: dict[str, str] | None = None) -> DataFrame:
    """Elements `row` of XML files. A file is read in ranges: what follows one "<row" up to the next belongs to the range
    in which it begins, as a line would. "<" can't stand in an attribute, so a record begins with the rest of its start tag.

    `only` gives attributes and the values they must have: other records are passed over before they are parsed.
    """
    read = spark.read.option("lineSep", "<row").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))
    tag = F.regexp_extract("value", START_TAG, 1)
    rows = read.select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where(F.col("value").rlike(START_TAG))
    wanted = {a: v for a, v in (only or {}).items() if v is not None}
    for name, value in wanted.items():
        if re.fullmatch(r"[\w.:-]*", value):
            rows = rows.where(F.col("value").rlike(_attribute(name, value)))
    schema = ", ".join(f"{a} string" for a in attributes)
    parsed = F.from_xml(F.concat(F.lit("<row"), F.regexp_replace(tag, r"/\s*$", ""), F.lit("/>")), schema)
    rows = rows.select(parsed.alias("row"), "file", "place").select(*[F.col("row")[a].alias(c) for a, c in attributes.items()], "file", "place")
    for name, value in wanted.items():
        rows = rows.where(F.col(attributes[f"_{name}"]) == value)
    return rows.where(" or ".join(f"{c} is not null" for c in attributes.values()))


def read_posts(spark: SparkSession, path: str, post_type: str | None = None, post_id: str | None = None) -> DataFrame:
    """All rows of XML dumps, attributes as strings, with (file, place) giving their order; or those of one type or id.

    Many tasks read one file, in ranges of spark.sql.files.maxPartitionBytes. Rows without any known attribute, and text
    between elements, are skipped; a comment that holds a row isn't told apart from one.
    """
    return _rows(spark, path, ATTRIBUTES, {"PostTypeId": post_type, "Id": post_id})


def read_comments(spark: SparkSession, path: str, post_id: str | None = None) -> DataFrame:
    """All rows of XML dumps of comments, or those on one post, as read_posts reads posts."""
    return _rows(spark, path, COMMENT_ATTRIBUTES, {"PostId": post_id})


def write_posts(posts: DataFrame, path: str) -> None:
    """Write rows as XML dumps, an element `row` each: attributes are the columns that ATTRIBUTES names; null ones are left out."""
    some = [F.col(c).cast("string").alias(a) for a, c in ATTRIBUTES.items() if c in posts.columns]
    posts.select(*some).write.format("xml").option("rowTag", "row").option("rootTag", "posts").save(path)


def attach_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with `comments`, the array of comments on each in order of their number, by one row per post and comment;
    null without any. Comments on no post are lost."""
    n = F.col("id").try_cast("bigint")
    kept = comments.where(F.col("post_id").isNotNull()).groupBy(F.col("post_id").alias("_of")).agg(F.collect_list(F.struct(n.alias("n"), F.struct("id", "score", "text", "creation_date").alias("c"))).alias("_c"))
    kept = kept.select("_of", F.transform(F.array_sort("_c"), lambda c: c["c"]).alias("comments"))
    return posts.join(kept, F.col("id").cast("string") == F.col("_of"), "left").drop("_of")


def typed(posts: DataFrame) -> DataFrame:
    """Numbers as long and the date as timestamp; what can't be read becomes null."""
    casts = {c: F.col(c).try_cast("bigint") for c in NUMBERS if c in posts.columns}
    return posts.withColumns(casts | {"creation_date": F.col("creation_date").try_cast("timestamp")})


def is_answer(post_type: Column) -> Column:
    """'2' is an answer; anything else, missing too, is a post."""
    return F.coalesce(post_type == "2", F.lit(False))


def clean_attributes(posts: DataFrame, compat: bool = False) -> DataFrame:
    return posts.withColumns({c: tx.clean_string(F.col(c), compat) for c in ("body", "title")})


def _starts(counts: DataFrame) -> DataFrame:
    """(part, start) of counts (part, count): how many rows the parts before have; a row for each part."""
    out, start = [], 0
    for r in counts.orderBy("part").collect():
        out.append((r["part"], start))
        start += r["count"]
    return counts.sparkSession.createDataFrame(out, "part int, start long")


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """df with 1-based places in the given order, and `part`: parts hold ranges of it, in order.

    Counts of the parts are all that reaches the driver; no task has to hold more than a part.
    """
    n = max(1, math.ceil(df.count() / ORDERED))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ordinals")
    placed = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return placed.join(_starts(ranged.groupBy("part").count()), "part").select(*df.columns, "part", (F.col("start") + F.col("_k")).alias(name))


def in_range(ordinal: Column, lo: int, hi: int) -> Column:
    """Ordinals lo to hi, both included; without an end if hi is below max(lo, 1)."""
    return ordinal >= max(lo, 1) if hi < max(lo, 1) else ordinal.between(max(lo, 1), hi)


def posts_in_range(rows: DataFrame, lo: int, hi: int, *order: str, answer: Column | None = None, exclusive: bool = False) -> DataFrame:
    """Posts of the range by their ordinal among posts. exclusive leaves out lo itself, so that adjacent ranges share none."""
    posts = rows.where(~(is_answer(F.col("post_type")) if answer is None else answer))
    return with_ordinal(posts, *order).where(in_range(F.col("ordinal"), lo + 1 if exclusive else lo, hi)).drop("part")


def attach_positional(rows: DataFrame, answer: Column, *order: str, lo: int = 1, hi: int = 0) -> DataFrame:
    """Posts of the range with the answers that precede them in the file.

    An answer belongs to the next post of the range, whatever its parent; posts outside the range don't take any,
    answers after the last post are lost, and a post without answers has null. Adds post_ordinal and answers.
    """
    keyed = with_ordinal(rows.select(F.struct("*").alias("row"), answer.alias("is_answer"), *order), *order, name="_at")
    posts_of = keyed.groupBy("part").agg(F.count(F.when(~F.col("is_answer"), 1)).alias("count"))
    keyed = keyed.join(_starts(posts_of), "part")
    by_place, by_place_down = (Window.partitionBy("part").orderBy(o) for o in ("_at", F.desc("_at")))
    post = F.col("start") + F.sum((~F.col("is_answer")).cast("int")).over(by_place)
    keyed = keyed.withColumn("post_ordinal", F.when(~F.col("is_answer"), post)).withColumn("emitted", ~F.col("is_answer") & F.coalesce(in_range(F.col("post_ordinal"), lo, hi), F.lit(False)))
    keyed = stored(keyed.withColumn("own", F.when(F.col("emitted"), F.col("_at"))), "answers")
    later, carry = {}, None
    firsts = {r["part"]: r["own"] for r in keyed.groupBy("part").agg(F.min("own").alias("own")).collect()}
    for part in sorted(firsts, reverse=True):
        later[part] = carry
        carry = firsts[part] if firsts[part] is not None else carry
    following = rows.sparkSession.createDataFrame(list(later.items()), "part int, following long")
    ahead = by_place_down.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # backwards: a frame without an end is computed anew for each row
    owned = keyed.join(following, "part").withColumn("owner", F.coalesce(F.min("own").over(ahead), F.col("following")))
    answers = owned.where("is_answer and owner is not null").groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "row"))), lambda a: a["row"]).alias("answers"))
    return keyed.where("emitted").join(answers, F.col("_at") == F.col("owner"), "left").select("row.*", "post_ordinal", "answers")


def attach_by_parent(posts: DataFrame, answers: DataFrame, id_col: str = "id", parent_col: str = "parent_id", *order: str) -> DataFrame:
    """Posts with the answers that name them as parent, in order; null without any."""
    keys = order or (id_col,)
    found = answers.groupBy(F.col(parent_col).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(*keys, F.struct("*").alias("row")))).alias("a"))
    found = found.select("_parent", F.transform("a", lambda a: a["row"]).alias("answers"))
    return posts.join(found, F.col(id_col) == F.col("_parent"), "left").drop("_parent")


def accepted_answer(answers: Column, accepted: Column) -> Column:
    """The first answer with the accepted id, or null."""
    return F.get(F.filter(answers, lambda a: a["id"] == accepted), F.lit(0))


def append(array: Column, item: Column) -> Column:
    """The array with one more item; a null array counts as empty."""
    return F.when(array.isNull(), F.array(item)).otherwise(F.array_append(array, item))


def post_text(post_id: Column, answers: Column) -> Column:
    listed = F.concat(F.lit("["), F.array_join(F.transform(answers, lambda a: answer_text(a["id"])), ", "), F.lit("]"))
    return F.format_string("Post( id = %s, answers = %s )", post_id, F.coalesce(listed, F.lit("None")))


def answer_text(answer_id: Column) -> Column:
    return F.format_string("Answer( id = %s)", answer_id)


def comment_text(comment_id: Column) -> Column:
    return F.format_string("Comment( id = %s)", comment_id)


def find_post(posts: DataFrame, post_id) -> DataFrame:
    return posts.where(F.col("id") == post_id).limit(1)


def title_tokens(posts: DataFrame, id_col: str = "id", title_col: str = "title", limit: int = tx.SENTENCE) -> DataFrame:
    """(id, tokens) of posts with at least one token."""
    return posts.select(F.col(id_col).alias("id"), tx.words_array(F.col(title_col), limit).alias("tokens")).where(F.size("tokens") > 0)


def sentences(posts: DataFrame, ordinal_col: str = "ordinal", title_col: str = "title") -> DataFrame:
    """(tag, words): words of the title, stop words kept, and the 0-based place of the post."""
    return posts.select((F.col(ordinal_col) - 1).alias("tag"), tx.words(F.col(title_col)).alias("words"))


def body_words(posts: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    return posts.select(F.col(id_col).alias("id"), F.posexplode(tx.words(F.col(body_col))).alias("place", "word"))
