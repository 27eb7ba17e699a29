"""Tables dumped as XML: ``<table name=..><column name=..>text</column>..</table>`` per row.

One file is cut at the closing row tags and read by many tasks. A tag inside a CDATA section or a comment
is text, so some pieces may begin inside such a section. What a piece does is a function of the state it
begins in: from text, from a CDATA section, from a comment it ends in one of the three. These functions
are composed over runs of pieces, over the runs of a split and over the splits of a file, which tells each
piece its state; pieces that begin inside a section go back to the piece they were cut from. None of this
is needed where no piece that begins in text ends inside a section, and that is looked up first.
"""

from pyspark.sql import Window, functions as F

from tallyline.session import written

RECORD = "_name string, column array<struct<_VALUE:string,_name:string>>"
SECTION = r"<!\[CDATA\[.*?\]\]>"
TEXT, CDATA, COMMENT = 0, 1, 2
RUN = 256  # pieces whose functions are composed at a time


def dump_rows(spark, path, columns, row_tag="table", splittable=True):
    """One row per dumped row, with the named columns as text; a missing column is null.

    Comments are left out. ``splittable=False`` reads each file in one task.
    """
    if splittable:
        record = _split_records(spark, path, row_tag)
    else:
        record = spark.read.format("xml").option("rowTag", row_tag).schema(RECORD).load(path)
    cells = record.select("column")
    return cells.select(*[_cell(c).alias(c) for c in columns])


def _end_of_text(text):
    """The state in which a piece ends that begins in text: that of the first section it leaves open."""
    open_ones = F.regexp_replace(text, f"(?s){SECTION}|<!--.*?-->", " ")
    cdata, comment = F.instr(open_ones, F.lit("<![CDATA[")), F.instr(open_ones, F.lit("<!--"))
    return (
        F.when((cdata > 0) & ((comment == 0) | (cdata < comment)), CDATA).when(comment > 0, COMMENT).otherwise(TEXT)
    )


def _end_of_section(text, mark, state):
    """The state in which a piece ends that begins in a section which `mark` closes."""
    at = F.instr(text, F.lit(mark))
    return F.when(at == 0, state).otherwise(_end_of_text(F.substring(text, at + len(mark), F.length(text))))


def _ends(text):
    """A piece's function: the state it ends in, for each state it may begin in."""
    return F.array(_end_of_text(text), _end_of_section(text, "]]>", CDATA), _end_of_section(text, "-->", COMMENT))


def _composed(parts):
    """The function of sorted parts that have an `ends` each."""
    start = F.array(F.lit(TEXT), F.lit(CDATA), F.lit(COMMENT))
    return F.aggregate(parts, start, lambda all_, part: F.transform(all_, lambda state: F.get(part["ends"], state)))


def _parts(df, by, *order):
    """The parts of each group, sorted."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "ends"))).alias("parts"))


def _begun(groups, begin, kept):
    """For each part of groups, the state it begins in, given that of its group."""
    def step(held, part):
        state = F.get(part["ends"], held["state"])
        said = F.struct(*[part[c].alias(c) for c in kept], held["state"].alias("state"))
        return F.struct(state.alias("state"), F.array_append(held["seen"], said).alias("seen"))

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema["parts"].dataType.elementType}
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in kept) + ",state:int>>")
    return F.aggregate("parts", F.struct(begin.alias("state"), empty.alias("seen")), step, lambda held: held["seen"])


def _states(pieces):
    """(file, split, place, state) of the pieces that do not begin in text."""
    runs = written(_parts(pieces, ["file", "split", "run"], "place"), "xml-runs")
    runs_of = _parts(runs.select("file", "split", "run", _composed("parts").alias("ends")), ["file", "split"], "run")
    runs_of = written(runs_of, "xml-splits")
    splits = _parts(runs_of.select("file", "split", _composed("parts").alias("ends")), ["file"], "split")
    of_splits = splits.select("file", F.inline(_begun(splits, F.lit(TEXT), ["split"])))
    begun = runs_of.join(of_splits, ["file", "split"])
    of_runs = begun.select("file", "split", F.inline(_begun(runs_of, F.col("state"), ["run"])).alias("run", "begin"))
    begun = runs.join(of_runs, ["file", "split", "run"])
    found = begun.select("file", "split", F.inline(_begun(runs, F.col("begin"), ["place"])))
    return written(found.where(F.col("state") != TEXT), "xml-states")


def _rejoined(pieces, closing):
    """Pieces as `value`, those cut inside a section put together again."""
    place = F.monotonically_increasing_id()
    pieces = pieces.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), place.alias("place"), "value",
        _ends(F.col("value")).alias("ends"),
    )
    pieces = written(pieces.withColumn("run", F.floor(F.col("place") / RUN)), "xml-pieces")
    marked = pieces.join(_states(pieces), ["file", "split", "place"], "left").withColumn("state", F.coalesce("state", F.lit(TEXT)))
    cut = (F.col("state") != TEXT) | (F.get("ends", F.col("state")) != TEXT)
    order = Window.partitionBy("file").orderBy("split", "place")
    head = F.when(F.col("state") == TEXT, F.struct("split", "place"))
    parts = marked.where(cut).withColumn("head", F.last(head, ignorenulls=True).over(order))
    whole = parts.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("split", "place", "value"))).alias("parts"))
    return marked.where(~cut).select("value").union(whole.select(F.array_join(F.col("parts.value"), closing).alias("value")))


def _split_records(spark, path, row_tag):
    closing = f"</{row_tag}>"
    opening = f"<\\Q{row_tag}\\E[\\s>]"
    pieces = spark.read.option("lineSep", closing).text(path)
    if not pieces.where(_end_of_text(F.col("value")) != TEXT).isEmpty():
        pieces = _rejoined(pieces, closing)
    said = F.regexp_replace("value", f"(?s)({SECTION})|<!--.*?-->", "$1")
    rows = F.regexp_count(F.regexp_replace(said, f"(?s){SECTION}", ""), F.lit(opening))
    text = F.concat(F.regexp_substr(said, F.lit(f"(?s){opening}.*")), F.lit(closing))
    record = F.when(rows == 1, text).otherwise(F.raise_error(f"{row_tag} tags inside each other"))
    return (
        pieces.where(rows > 0)
        .select(F.from_xml(record, RECORD, {"rowTag": row_tag, "mode": "FAILFAST"}).alias("record"))
        .select("record.column")
    )


def _cell(name):
    """Text of the first column element of that name."""
    return F.get(F.filter("column", lambda c: c["_name"] == name), F.lit(0))["_VALUE"]


def write_dump(df, path, table, row_tag="table", root_tag="database"):
    """Write a DataFrame as such a dump, every column as text."""
    cells = [F.struct(F.col(c).cast("string").alias("_VALUE"), F.lit(c).alias("_name")) for c in df.columns]
    (
        df.select(F.lit(table).alias("_name"), F.array(*cells).alias("column"))
        .write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag)
        .mode("overwrite").save(path)
    )
