"""Headings, chunks, links and other edges of notes, by built-in expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_text, slug, strip, upto, without_code
from ..model import positive

HEADING = r"(?mU)^(#{1,6})(\s+)(.+?)(\s*)$"


def sections(notes: DataFrame) -> DataFrame:
    """(note_id, pos, level, title, slug, body): one row before the first heading, of level 0, then one for each heading."""
    clean = F.translate(F.coalesce("body", F.lit("")), "\x00\x01\x02", "")
    parts = F.split(F.regexp_replace(clean, HEADING, "\x00$1\x01$2\x01$3\x02$4"), "\x00")
    rows = notes.select(F.col("id").alias("note_id"), F.posexplode(parts).alias("pos", "part"))
    head = F.split(F.substring_index("part", "\x02", 1), "\x01")
    rest = F.substr(F.col("part"), F.instr("part", "\x02") + 1)
    # A section begins after the line of its heading's marks, even where the heading's text is on a later line.
    line = F.when(F.instr(head[1], "\n") > 0, F.concat(head[1], head[2], rest)).otherwise(rest)
    after = F.when(F.instr(line, "\n") > 0, F.substr(line, F.instr(line, "\n") + 1)).otherwise(F.lit(""))
    first = F.col("pos") == 0
    return rows.select(
        "note_id",
        "pos",
        F.when(first, 0).otherwise(F.length(head[0])).alias("level"),
        F.when(~first, head[2]).alias("title"),
        F.when(~first, slug(head[2])).alias("slug"),
        strip(F.when(first, F.col("part")).otherwise(after)).alias("body"),
    )


def headings(notes: DataFrame) -> DataFrame:
    """(id, note_id, level, slug, text), id being note#slug-position."""
    rows = sections(notes).where("pos > 0")
    return rows.select(F.concat("note_id", F.lit("#"), "slug", F.lit("-"), F.col("pos") - 1).alias("id"), "note_id", F.col("level").cast("long").alias("level"), "slug", F.col("title").alias("text"))


def breadcrumbs(rows: DataFrame) -> DataFrame:
    """sections() with path and slugs: the headings a section is under, itself last. The nearest earlier heading of a level counts if none of a lesser level came after it."""
    upto = Window.partitionBy("note_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {n: F.last(F.when(F.col("level") == n, F.struct("pos", "title", "slug")), ignorenulls=True).over(upto) for n in range(1, 7)}
    rows = rows.withColumns({f"h{n}": c for n, c in last.items()})
    place = lambda n: F.coalesce(F.col(f"h{n}.pos"), F.lit(-1))
    on = {n: (F.col("level") >= n) & (place(n) > (F.greatest(F.lit(-1), *(place(m) for m in range(1, n))) if n > 1 else F.lit(-1))) for n in range(1, 7)}
    joined = lambda field, by: F.concat_ws(by, *(F.when(on[n], F.col(f"h{n}.{field}")) for n in range(1, 7)))
    return rows.withColumns({"path": joined("title", " > "), "slugs": joined("slug", "/")}).drop(*(f"h{n}" for n in range(1, 7)))


def pieces(text: Column, most: int) -> Column:
    """Parts of a text of most characters at most: paragraphs are packed, and sliced where one alone is longer."""
    t = strip(text)
    slices = F.flatten(F.transform(F.split(t, "\n{2,}"), lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(x), F.lit(1)) - 1) / most).cast("int")), lambda i: F.substr(x, i * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, x: Column) -> Column:
        joined = F.when(acc["now"] == "", x).otherwise(F.concat(acc["now"], F.lit("\n\n"), x))
        over = (acc["now"] != "") & (F.length(joined) > most)
        return F.struct(F.when(over, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(over, x).otherwise(joined).alias("now"))

    packed = F.aggregate(slices, start, add, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(packed)


def chunks(notes: DataFrame, strategy: str = "heading", most: int = 2000) -> DataFrame:
    """(id, note_id, chunk_index, heading_path, text, search_text, modality) of every note.

    The first piece of a section begins with its breadcrumb, or the note's title and description, which its budget
    doesn't count. strategy: "heading" or "whole-note".
    """
    if strategy not in ("heading", "whole-note"):
        raise ValueError('strategy must be "heading" or "whole-note"')
    positive(most, "most")
    intro = notes.select(F.col("id").alias("note_id"), strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("desc", F.lit("")))).alias("intro"))
    if strategy == "heading":
        rows = breadcrumbs(sections(notes)).select("note_id", "pos", "path", "slugs", "body")
    else:
        rows = notes.select(F.col("id").alias("note_id"), F.lit(0).alias("pos"), F.lit("").alias("path"), F.lit("").alias("slugs"), strip(F.coalesce("body", F.lit(""))).alias("body"))
    rows = rows.join(intro, "note_id").withColumn("prefix", F.when(F.col("pos") == 0, F.col("intro")).otherwise(F.col("path")))
    parts = pieces(F.col("body"), most)
    rows = rows.withColumn("parts", F.when(F.size(parts) > 0, parts).when(F.col("prefix") != "", F.array(F.lit(""))).otherwise(parts))
    rows = rows.withColumn("count", F.size("parts")).select("*", F.posexplode("parts").alias("part", "piece"))
    base = F.when(F.col("slugs") != "", F.concat("note_id", F.lit("#"), "slugs")).otherwise(F.col("note_id"))
    wanted = F.when(F.col("count") > 1, F.concat(base, F.lit("#part-"), F.col("part") + 1)).otherwise(base)
    text = F.when(F.col("part") == 0, F.concat_ws("\n\n", F.when(F.col("prefix") != "", F.col("prefix")), F.when(F.col("piece") != "", F.col("piece")))).otherwise(F.col("piece"))
    rows = rows.withColumns({"wanted": wanted, "text": text})
    same = F.row_number().over(Window.partitionBy("note_id", "wanted").orderBy("pos", "part"))
    index = F.row_number().over(Window.partitionBy("note_id").orderBy("pos", "part")) - 1
    rows = rows.withColumns({"same": same, "chunk_index": index.cast("long")})
    return rows.select(
        F.when(F.col("same") > 1, F.concat("wanted", F.lit("~"), "same")).otherwise(F.col("wanted")).alias("id"), "note_id", "chunk_index", F.col("path").alias("heading_path"), "text", search_text(F.col("text")).alias("search_text"), F.lit("text").alias("modality")
    )


def wikilinks(notes: DataFrame, empty: bool = False) -> DataFrame:
    """(source, target, anchor, raw, pos), a row for each link outside code; those without a target only if empty is set."""
    found = F.regexp_extract_all(without_code(F.coalesce("body", F.lit(""))), F.lit(r"\[\[([^\]]+)\]\]"), 1)
    rows = notes.select(F.col("id").alias("source"), F.posexplode(found).alias("pos", "raw"))
    full = F.when(F.instr("raw", "|") > 0, F.split("raw", r"\|")[1]).otherwise(F.col("raw"))
    hashed = F.instr(full, "#") > 0
    target = strip(F.when(hashed, F.split(full, "#")[0]).otherwise(full))
    anchor = slug(F.when(hashed, F.split(full, "#")[1]))
    rows = rows.select("source", target.alias("target"), F.when(anchor != "", anchor).alias("anchor"), "raw", "pos")
    return rows if empty else rows.where("target <> ''")


def hierarchy(ids: DataFrame) -> DataFrame:
    """(parent, child) for each step of each dotted id, whether or not such notes exist."""
    n = F.size(F.split("id", r"\."))
    rows = ids.where(n > 1).select("id", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    return rows.select(upto(F.col("id"), F.col("i")).alias("parent"), upto(F.col("id"), F.col("i") + 1).alias("child")).distinct()


def exploded(notes: DataFrame, column: str, name: str) -> DataFrame:
    """(note_id, name) for each item of a list, repeated ones too."""
    return notes.select(F.col("id").alias("note_id"), F.explode(column).alias(name)).where(F.col(name).isNotNull())


def schema_children(schemas: DataFrame, notes: DataFrame) -> DataFrame:
    """(schema_id, child_id) for the listed children that exist."""
    rows = schemas.select(F.explode("schemas").alias("s")).select(F.col("s.id").alias("schema_id"), F.explode("s.children").alias("child"))
    rows = rows.select("schema_id", F.when(F.col("schema_id") == "root", F.col("child")).otherwise(F.concat("schema_id", F.lit("."), "child")).alias("child_id"))
    return rows.join(notes.select(F.col("id").alias("child_id")), "child_id", "left_semi").select("schema_id", "child_id")


def existing(edges: DataFrame, notes: DataFrame, *ends: str) -> DataFrame:
    """The edges whose ends are notes; repeated edges stay."""
    for end in ends:
        edges = edges.join(notes.select(F.col("id").alias(end)), end, "left_semi")
    return edges
