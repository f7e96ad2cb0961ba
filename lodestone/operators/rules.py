"""Quality rules over notes. Each gives rows (seq, rule, note_id, message); seq is the order in which findings are reported."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STATUSES, upto
from .extract import sections, wikilinks

EMPTY = "seq int, rule string, note_id string, message string"


def finding(rows: DataFrame, seq: int, rule: str, message: Column, note: str = "id") -> DataFrame:
    return rows.select(F.lit(seq).alias("seq"), F.lit(rule).alias("rule"), F.col(note).alias("note_id"), message.alias("message"))


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def missing_root(notes: DataFrame) -> DataFrame:
    count = notes.agg(F.count(F.when(F.col("id") == "root", 1)).alias("n")).where("n = 0").withColumn("id", F.lit("root"))
    return finding(count, 0, "root", F.lit("vault is missing required `root.md`"))


def front_matter_errors(notes: DataFrame) -> Column:
    """A list of what is wrong with a note's typed columns; the reader's own findings about types come first."""
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"frontmatter.{c} must not be empty")) for c in ("fm_id", "title", "desc")]
    status = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("frontmatter.status must be draft, active or deprecated"))
    rest = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"frontmatter.{c} must not be empty")) for c in ("owner", "last_verified")]
    ttl = F.when(F.coalesce(F.col("ttl_days") < 0, F.lit(True)), F.lit("frontmatter.ttl_days must be a whole number of 0 or more"))
    refs = F.when(F.exists("code_refs", lambda r: (F.coalesce(r["file"], F.lit("")) == "") | (F.coalesce(r["symbol"], F.lit("")) == "")), F.lit("frontmatter.code_refs needs a file and a symbol each"))
    given = F.coalesce("fm_errors", F.array().cast("array<string>"))
    return F.concat(given, F.when(F.size(given) > 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*missing, status, *rest, ttl, refs))))


def with_validity(notes: DataFrame) -> DataFrame:
    return notes.withColumn("problems", front_matter_errors(notes)).withColumn("valid", F.size("problems") == 0)


def front_matter(notes: DataFrame) -> DataFrame:
    rows = with_validity(notes).select("id", F.explode("problems").alias("problem"))
    return finding(rows, 1, "front_matter", text("[", F.col("id"), "] ", F.col("problem")))


def id_matches(notes: DataFrame) -> DataFrame:
    rows = notes.where(F.coalesce("fm_id", F.lit("")) != F.col("id"))
    return finding(rows, 2, "id", text("[", F.col("id"), '] frontmatter.id "', F.coalesce("fm_id", F.lit("")), '" does not match filename id "', F.col("id"), '"'))


def extra_fields(notes: DataFrame, required: list[str]) -> DataFrame:
    """A field that is there with a null passes."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(F.map_contains_key("extra", f), F.lit(False)) | F.coalesce(F.try_element_at("extra", F.lit(f)) == "", F.lit(False)), F.lit(f)) for f in required))) if required else F.array().cast("array<string>")
    rows = notes.select("id", F.explode(found).alias("f"))
    return finding(rows, 3, "extra_fields", text("[", F.col("id"), "] frontmatter missing configured field: ", F.col("f")))


def missing_ancestors(notes: DataFrame) -> DataFrame:
    n = F.size(F.split("id", r"\."))
    ups = notes.where((n > 1) & (F.col("id") != "root")).select("id", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).select("id", upto(F.col("id"), F.col("i")).alias("up"))
    rows = ups.join(notes.select(F.col("id").alias("up")), "up", "left_anti")
    return finding(rows, 4, "ancestors", text("[", F.col("id"), '] missing ancestor "', F.col("up"), '.md" in the hierarchy'))


def schema_rules(notes: DataFrame, schemas: DataFrame) -> DataFrame:
    """A schema file must be there, declare its own entry, list all direct children unless open, and list no note that isn't there."""
    empty = schemas.where(F.coalesce(F.size("schemas"), F.lit(0)) <= 0)
    own = F.filter("schemas", lambda s: s["id"] == F.col("top"))
    full = schemas.where(F.coalesce(F.size("schemas"), F.lit(0)) > 0).withColumn("own", own)
    entry = full.where(F.size("own") > 0).select("top", F.coalesce(F.col("own")[0]["namespace"], F.lit(False)).alias("open"), F.coalesce(F.col("own")[0]["children"], F.array().cast("array<string>")).alias("children"))
    out = finding(empty, 5, "schema", text(F.col("top"), ".schema.yml is empty or malformed"), "top")
    out = out.unionByName(finding(full.where(F.size("own") <= 0), 5, "schema", text(F.col("top"), '.schema.yml does not declare a schema with id "', F.col("top"), '"'), "top"))
    parts = F.split("id", r"\.")
    direct = notes.where("id <> 'root'").where(F.size(parts) <= 2).select("id", F.when(F.size(parts) == 1, F.lit("root")).otherwise(parts[0]).alias("top"), F.element_at(parts, -1).alias("leaf"))
    # A note of one part is a direct child of root alone, one of two parts of its first part, even if that is "root".
    rogue = direct.join(entry.where("not open"), "top").where(~F.array_contains("children", F.col("leaf")))
    rogue = rogue.where((F.size(F.split("id", r"\.")) == 2) != (F.col("top") == "root"))
    out = out.unionByName(finding(rogue, 5, "schema", text("[", F.col("id"), "] not in ", F.col("top"), ".schema.yml children")))
    listed = entry.select("top", F.explode(F.array_distinct("children")).alias("child")).withColumn("child_id", F.when(F.col("top") == "root", F.col("child")).otherwise(F.concat("top", F.lit("."), "child")))
    absent = listed.join(notes.select(F.col("id").alias("child_id")), "child_id", "left_anti")
    return out.unionByName(finding(absent, 5, "schema", text(F.col("top"), '.schema.yml lists child "', F.col("child"), '" but note ', F.col("child_id"), ".md does not exist"), "child_id"))


def broken_links(notes: DataFrame) -> DataFrame:
    """Links to notes that aren't there, one without a target among them, and to headings that aren't."""
    links = wikilinks(notes, empty=True)
    known = notes.select(F.col("id").alias("target"))
    gone = links.join(known, "target", "left_anti")
    out = finding(gone, 6, "links", text("[", F.col("source"), '] wikilink "[[', F.col("raw"), ']]" points at unknown note "', F.col("target"), '"'), "source")
    slugs = sections(notes).where("pos > 0").select(F.col("note_id").alias("target"), F.col("slug").alias("anchor")).distinct()
    lost = links.where("anchor is not null").join(known, "target", "left_semi").join(slugs, ["target", "anchor"], "left_anti")
    return out.unionByName(finding(lost, 6, "links", text("[", F.col("source"), '] wikilink "[[', F.col("raw"), ']]" points at a missing heading in ', F.col("target"), ".md"), "source"))


def freshness(notes: DataFrame, as_of: datetime.date) -> DataFrame:
    """Valid notes, unless deprecated, whose last check is longer ago than they allow; the day of expiry is still fresh."""
    rows = with_validity(notes).where("valid and status <> 'deprecated'")
    day = F.when(F.col("last_verified").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp("last_verified", F.lit("yyyy-MM-dd")).cast("date"))
    rows = rows.withColumn("day", day).withColumn("late", F.datediff(F.lit(as_of), F.date_add("day", F.col("ttl_days").cast("int"))))
    bad = finding(rows.where("day is null"), 8, "freshness", text("[", F.col("id"), "] invalid last_verified: ", F.col("last_verified")))
    return bad.unionByName(finding(rows.where("late > 0"), 8, "freshness", text("[", F.col("id"), "] freshness expired ", F.col("late").cast("string"), " day(s) ago")))


def invariants(notes: DataFrame, given: DataFrame) -> DataFrame:
    """given: (id, value, used_in). Each note named must have the token {{id}} and the value in its body."""
    used = given.select("id", "value", F.explode("used_in").alias("note_id")).join(notes.select(F.col("id").alias("note_id"), "body"), "note_id", "left")
    token = F.concat(F.lit("{{"), "id", F.lit("}}"))
    gone = used.where("body is null")
    out = finding(gone, 9, "invariants", text("externalInvariant.", F.col("id"), ' references missing note "', F.col("note_id"), '"'), "note_id")
    there = used.where("body is not null")
    out = out.unionByName(finding(there.where(F.instr("body", token) == 0), 9, "invariants", text("[", F.col("note_id"), "] missing invariant token ", token), "note_id"))
    return out.unionByName(finding(there.where(F.instr("body", F.col("value")) == 0), 9, "invariants", text("[", F.col("note_id"), "] invariant ", F.col("id"), ' value "', F.col("value"), '" is not present'), "note_id"))


def refinement_rules(records: DataFrame) -> DataFrame:
    """Promoted records need a time and notes, rejected ones a time and a reason."""
    bad = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    promoted, rejected = F.col("status") == "promoted", F.col("status") == "rejected"
    checks = [
        (promoted & bad("promoted_at"), "promoted refinement is missing promoted_at"),
        (promoted & (F.coalesce(F.size("promoted_notes"), F.lit(0)) <= 0), "promoted refinement is missing promoted_notes"),
        (rejected & bad("rejected_at"), "rejected refinement is missing rejected_at"),
        (rejected & bad("rejection_reason"), "rejected refinement is missing rejection_reason"),
    ]
    rows = records.select("id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))).alias("m"))
    return finding(rows, 10, "refinements", text("refinement [", F.col("id"), "] ", F.col("m")))


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMPTY)
