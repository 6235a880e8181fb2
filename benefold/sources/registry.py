"""Reading the nested registry with an explicit schema: JSON lines, one array, or an envelope around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import first_present, short_hash

_AGE = "STRUCT<targetAge: INT, targetAgeOfMonths: INT>"
_LINKS = "ARRAY<STRUCT<title: STRING, uri: STRING>>"
_PERIOD = "STRUCT<fromYMD: STRING, toYMD: STRING, fromHM: STRING, toHM: STRING, conditions: STRING>"

# Names of the source's fields.
IDS = ("制度ID", "benefit_id", "benefitId", "id", "psid")
TITLES = ("制度名", "title", "name", "serviceName")
CATEGORIES = ("カテゴリ", "category", "categoryName", "genre")
SUMMARIES = ("概要", "summary", "description", "outline")
ENVELOPE = ("data", "results", "items", "records")
PLAIN = ("必要書類", "documents", "requiredDocuments", "belongings", "utilization", "specificDate", "remarks", "cost", "costConditions", "procedureMethod",
         "procedureCounter", "procedurePersons", "capacity", "holiday", "updateDate")
SCHEMA = ", ".join([
    *(f"`{c}` STRING" for c in dict.fromkeys((*IDS, *TITLES, *CATEGORIES, *SUMMARIES, *PLAIN))),
    "basicInformation STRUCT<psid: STRING, organization: STRING, institutionType: INT, compartment: STRING, compartmentCode: STRING>",
    "institutionName STRUCT<canonicalName: STRING, shortName: STRING>", "area STRUCT<areaCode: STRING>",
    f"target STRUCT<greaterThanOrEqualTo: {_AGE}, greaterThan: {_AGE}, lessThan: {_AGE}, lessThanOrEqualTo: {_AGE}, targetPersons: STRING, conditions: STRING>",
    "tag STRUCT<categoryCode: ARRAY<STRING>, targetCode: ARRAY<STRING>, contentsCode: ARRAY<STRING>>",
    "support STRUCT<monetarySupport: STRING, materiallySupport: STRING, description: STRING>",
    "contact STRUCT<contactName: STRING, contactPhone: STRING, contactEx: STRING, contactEmail: STRING, contactUrl: STRING, contactAddress: STRING, zipCode: STRING, contactComment: STRING>",
    "regulation STRUCT<regulationName: STRING, regulationArticle: STRING>", "odInformation STRUCT<updateDate: STRING, updater: STRING, content: STRING>",
    "implementationPlace STRUCT<implementationName: STRING, implementationAddress: STRING>", "localGovernmentLink STRUCT<uri: STRING, title: STRING>",
    f"relatedLink {_LINKS}", f"formLink {_LINKS}", f"implementationPeriod {_PERIOD}", f"procedurePeriod {_PERIOD}",
    "utilizationTime STRUCT<fromHM: STRING, toHM: STRING, condiutilizationConditionstions: STRING, conditions: STRING>",
    "procedureDocumentsCode STRUCT<code: STRING, others: STRING>", "`class` INT", "electronicSubmission BOOLEAN", "useConsiderationFlag BOOLEAN",
])


#: Splits of files up to which their table of first numbers is broadcast.
MOST_SPLITS = 1 << 17
_BROKEN = "_broken"


def read_registry(spark: SparkSession, path: str, layout: str = "jsonl") -> DataFrame:
    """Records with record_seq (their order: files by name, in a file lines or elements). layout: jsonl, array, or envelope; all are read in splits.

    Lines and elements that are no objects are dropped, but are counted. Of an envelope the first of ``ENVELOPE`` that holds objects is read; an object
    without any of them is one record.
    """
    if layout == "jsonl":
        rows = numbered(spark.read.text(path)).where(F.trim("value").startswith("{")).withColumnRenamed("value", "raw")
    else:
        rows = _elements(spark, path, layout == "envelope")
    rows = rows.select("record_seq", F.from_json("raw", f"{SCHEMA}, {_BROKEN} STRING", {"columnNameOfCorruptRecord": _BROKEN}).alias("r"))
    return rows.where(F.col(f"r.{_BROKEN}").isNull()).select("record_seq", "r.*").drop(_BROKEN)


def _elements(spark: SparkSession, path: str, envelope: bool) -> DataFrame:
    """(record_seq, raw) of the objects of JSON documents of any size, read in splits.

    A document is read as pieces that end at ``}``. Whether a piece begins inside of a string, how deep it is nested and how many elements are before it depend on all that
    is before it, but only as sums: quotes modulo two, brackets, and commas between elements. Each is summed up by split, then over the splits of a file, then over the pieces of a
    split. The pieces of one element, which may lie in two splits, are joined in one exchange.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    most = len(lines.inputFiles()) + lines.rdd.getNumPartitions()
    near = lambda df: F.broadcast(df) if most <= MOST_SPLITS else df
    split = ["_file", "_block"]
    rows = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    bare = rows.withColumn("v", F.regexp_replace("value", r"(?s)\\.", ""))  # without escapes, then without strings: begun outside of one, and inside
    bare = bare.selectExpr("*", "(length(v) - length(replace(v, '\"', ''))) % 2 AS q", "regexp_replace(v, r'\"[^\"]*(\"|\\z)', '') AS o0", "regexp_replace('\"' || v, r'\"[^\"]*(\"|\\z)', '') AS o1").drop("v")
    deeper = lambda o: f"2 * length({o}) - length(translate({o}, '{{[', '')) - length({o}) - (length({o}) - length(translate({o}, ']', '')))"
    bare = bare.selectExpr("*", f"{deeper('o0')} - (1 - q) AS e0", f"{deeper('o1')} - q AS e1")
    here = Window.partitionBy(*split).orderBy("_id")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    bare = bare.withColumn("p", sum_before("q", before) % 2)
    pick = lambda s, a, b: F.when(s == 0, F.col(a)).otherwise(F.col(b))
    sums = bare.groupBy(*split).agg((F.sum("q") % 2).alias("q"), F.sum(pick(F.col("p"), "e0", "e1")).alias("a"), F.sum(pick(F.col("p"), "e1", "e0")).alias("b"))
    splits = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("s_in", sum_before("q", splits) % 2).withColumn("d_in", sum_before(pick(F.col("s_in"), "a", "b"), splits)).select(*split, "s_in", "d_in")
    rows = bare.join(near(sums), split).withColumn("s", (F.col("p") + F.col("s_in")) % 2)
    rows = rows.select("value", *split, "_id", "s", pick(F.col("s"), "o0", "o1").alias("o"), pick(F.col("s"), "e0", "e1").alias("e"), "d_in")
    rows = rows.withColumn("depth", F.col("d_in") + sum_before("e", before)).drop("e", "d_in")
    at = F.struct("_block", "_id")
    outside = F.col("s") == 0
    rest, others = r'(?s)^[^"\\]*+(?:\\.[^"\\]*+)*+"', r'(?s)^(?:[^{\["]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+'
    if envelope:
        seen = F.when(outside, F.col("value")).otherwise(F.regexp_replace("value", rest, ""))
        named = F.regexp_extract(seen, rf'"({"|".join(ENVELOPE)})"\s*:\s*\[(?!\s*\])', 1)
        rank = F.coalesce(*(F.when(named == k, i) for i, k in enumerate(ENVELOPE)))
        start = F.min(F.when((F.col("depth") <= 1) & rank.isNotNull(), F.struct(rank.alias("rank"), at.alias("at"))))
        files = rows.groupBy("_file").agg(start["at"].alias("start"))
        files = files.select("_file", "start", F.when(F.col("start").isNull(), 0).otherwise(2).alias("base"))
    else:
        files = rows.groupBy("_file").agg(F.min(at).alias("start")).withColumn("base", F.lit(1))
    rows = rows.join(near(files), "_file")
    first, base = (at == F.col("start")) & (F.col("base") > 0), F.col("base")
    begins = (F.col("depth") == base) & ~first  # outside of all objects, maybe inside of an element that is a string
    closes = begins & F.col("o").rlike(r"^[^\[{]*\]") & (at > F.col("start"))
    stops = rows.groupBy("_file").agg(F.min(F.when(closes, at)).alias("stop"))
    commas = lambda c: F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    more = F.when(first, commas(F.regexp_extract("o", r"\[([^{\[\]]*)\{", 1))).when(begins & (base > 0), commas(F.regexp_extract("o", r"^[^{\[\]]*", 0))).otherwise(0)
    rows = rows.join(near(stops), "_file").where(F.col("start").isNull() | ((at >= F.col("start")) & (F.col("stop").isNull() | (at < F.col("stop")))))
    rows = rows.where((base > 0) | (F.col("depth") > 0) | F.col("o").contains("{")).withColumn("more", more)
    counts = rows.groupBy(*split).agg(F.sum("more").alias("more")).withColumn("n_in", sum_before("more", splits)).drop("more")
    rows = rows.join(near(counts), split).withColumn("_at", (F.col("n_in") + F.sum("more").over(here)).cast("long"))
    head = rf'(?s)^.*?"(?:{"|".join(ENVELOPE)})"\s*:\s*\[' if envelope else r"^\s*\["
    text = F.when(first, F.regexp_replace("value", head, "")).when(begins & ~outside, F.regexp_replace("value", rest, "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", F.when((first | begins) & (base > 0), F.regexp_replace(text, others, "")).otherwise(text))  # an element begins at its brace
    found = rows.groupBy("_file", "_at").agg(F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))).alias("x"))  # the pieces of one element
    found = found.select("_file", "_at", F.concat(F.array_join("x.value", "}"), F.lit("}")).alias("raw")).where(F.trim("raw").startswith("{"))
    sizes = found.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    return found.join(near(_first_numbers(sizes, ["_file"])), "_file").select((F.col("_first") + F.col("_at")).alias("record_seq"), "raw")


def numbered(lines: DataFrame) -> DataFrame:
    """record_seq and value of the rows of a file reader: numbers without gaps, by file name and place in the file.

    Spark deals splits of files out by size, so neither partitions nor generated ids follow names. Rows of one split do follow each other; they are counted by split,
    the counts are summed up over the splits in order of name and start, and a row's number is its split's first number plus its place in the split.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = lines.select("value", *split, F.monotonically_increasing_id().alias("_id"))
    sizes = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    most = len(lines.inputFiles()) + lines.rdd.getNumPartitions()  # whole splits fill a partition, and a file has one smaller one at most
    rows = _shifted(rows, _first_numbers(sizes, ["_file", "_block"]), ["_file", "_block"], most)
    return rows.select((F.col("_first") + F.col("_id") - F.col("_low")).alias("record_seq"), "value")


def _first_numbers(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The first number of each split: the sum of the sizes (_n) before it. A row for each split of a file, not for each record."""
    before = F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("_first", F.coalesce(before, F.lit(0).cast("long"))).drop("_n")


def _shifted(rows: DataFrame, first: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """``rows`` with the first number of their split; of ``splits`` splits at most."""
    return rows.join(F.broadcast(first) if splits <= MOST_SPLITS else first, keys)


def benefit_id() -> Column:
    """A direct id that isn't the psid, else the psid, else a hash of the record and its place."""
    direct, psid = first_present(*(f"`{c}`" for c in IDS)), F.nullif(F.col("basicInformation.psid"), F.lit(""))
    whole = F.to_json(F.struct(F.col("*")))
    return F.coalesce(F.when(psid.isNull() | (direct != psid), direct), psid, F.concat(short_hash("BEN", whole, 16), F.lit("_"), F.col("record_seq").cast("string")))
