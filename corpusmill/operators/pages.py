"""From pages to typed rows: documents, chunks, entities out of embedded JSON, handbook sections, seed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.snapshots import last_wins

#: family of a page type (fixed values); other types are their own family
FAMILIES = {
    "course": "course_catalog", "faculty": "faculty", "handbook": "handbook_policy", "handbook_policy": "handbook_policy", "admissions": "admissions_general", "admissions_general": "admissions_general",
    "mission_values": "mission_values", "college_guidance": "college_guidance", "student_life": "student_life", "culture_community": "student_life", "museum_programs": "museum_programs",
    "unique_programs": "museum_programs", "athletics": "athletics", "publication": "academic_publications",
}
#: how long a family's pages count as fresh, in hours (fixed values)
FRESH_HOURS = {
    "athletics": 6, "faculty": 24, "admissions_general": 24, "student_life": 24, "college_guidance": 24, "course_catalog": 168, "handbook_policy": 168, "academic_publications": 168, "mission_values": 168, "museum_programs": 168,
}


def family(page_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, T.squeeze(page_type)), T.squeeze(page_type))


def stale(fetched: Column, family_: Column, now: Column) -> Column:
    """Whether a page is older than its family's cadence; families without one never are."""
    hours = F.try_element_at(F.create_map(*(F.lit(x) for pair in FRESH_HOURS.items() for x in pair)), family_)
    return F.coalesce(F.unix_micros(now) - F.unix_micros(fetched) > hours.cast("long") * 3_600_000_000, F.lit(False))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-(24 hex digits) of the parts; nulls and blanks differ."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, 24))


def merged_seeds(packs: DataFrame) -> DataFrame:
    """One entry per (url, page_type, school_year, department), the last standing where the first stood; entries without url go."""
    rows = packs.withColumn("url", T.squeeze_ends(F.coalesce("url", F.lit("")))).where("url <> ''").withColumn("page_type", T.squeeze_ends(F.coalesce("page_type", F.lit(""))))
    rows = rows.withColumn("_seen", F.col("ord"))
    return last_wins(rows, ["url", "page_type", "school_year", "department"], [F.col("_seen")], first_position="ord").drop("_seen")


def document_rows(pages: DataFrame, snapshot_id: str) -> DataFrame:
    """Documents of fetched pages (url, page_type, html): title, text, school year, family, ids and content hash."""
    out = pages.withColumn("title", T.html_title(F.col("html"))).withColumn("text", T.html_to_text(F.col("html")))
    out = out.withColumn("source_family", family(F.col("page_type"))).withColumn("school_year", T.first_school_year(F.col("title"), F.col("text"))).withColumn("snapshot_id", F.lit(snapshot_id))
    return out.withColumn("id", stable_id("document", F.col("snapshot_id"), F.col("url"))).withColumn("document_key", T.slug(F.col("url"))).withColumn("content_hash", F.sha2("text", 256)).drop("html")


def chunk_rows(documents: DataFrame, size: int = 500) -> DataFrame:
    """Chunks of documents (id, snapshot_id, title, text) with their place; the title heads every chunk."""
    parts = documents.select(F.col("id").alias("document_id"), "snapshot_id", "title", F.posexplode(T.chunks(F.col("text"), size)).alias("chunk_index", "part"))
    out = parts.withColumn("text", T.squeeze_ends(F.concat_ws("\n", "title", "part"))).drop("part", "title")
    return out.withColumn("normalized_text", T.normalize_text(F.col("text"))).withColumn("id", stable_id("chunk", F.col("document_id"), F.col("chunk_index"), F.col("text")))


def _field(obj: Column, *names: str) -> Column:
    """The first of the names with text in it."""
    return F.coalesce(*(F.nullif(T.squeeze(F.get_json_object(obj, f"$.{n}")), F.lit("")) for n in names))


def course_rows(objects: DataFrame) -> DataFrame:
    """Courses among JSON objects (.., object): those with a title, a description and a code or department."""
    o = F.col("object")
    rows = objects.select(
        *(c for c in objects.columns if c != "object"),
        _field(o, "title", "courseTitle", "name").alias("title"), _field(o, "description", "courseDescription").alias("description"), _field(o, "code", "courseCode").alias("course_code"),
        _field(o, "department", "departmentName").alias("department"), _field(o, "prerequisites", "prereqs").alias("prerequisites"), _field(o, "grades", "gradeEligibility").alias("grade_eligibility"),
    )
    rows = rows.where("title is not null and description is not null and coalesce(course_code, department) is not null")
    return rows.withColumn("course_key", T.slug(F.coalesce("course_code", "title")))


def faculty_rows(objects: DataFrame) -> DataFrame:
    """Staff among JSON objects: those with a name and a role, department or text about them."""
    o = F.col("object")
    rows = objects.select(*(c for c in objects.columns if c != "object"), _field(o, "name", "fullName").alias("name"), _field(o, "title", "role", "position").alias("role_title"), _field(o, "department").alias("department"), _field(o, "bio", "biography", "description").alias("bio"))
    return rows.where("name is not null and coalesce(role_title, department, bio) is not null").withColumn("faculty_key", T.slug(F.col("name")))


_TEAM = "struct<team_name:string,team:string,name:string,season:string,head_coach:string,coach:string,summary:string,games:array<struct<date:string,opponent:string,result:string,venue:string>>,records:array<struct<type:string,record_type:string,value:string>>>"


def teams(objects: DataFrame) -> DataFrame:
    """(.., place, team) of the team lists in JSON objects."""
    parsed = objects.withColumn("_t", F.from_json("object", f"struct<teams:array<{_TEAM}>>"))
    rows = parsed.select(*(c for c in objects.columns if c != "object"), F.posexplode("_t.teams").alias("place", "team"))
    name = F.coalesce(*(F.nullif(T.squeeze(F.col(f"team.{n}")), F.lit("")) for n in ("team_name", "team", "name")))
    return rows.withColumn("team_name", name).where("team_name is not null")


def games(team_rows: DataFrame) -> DataFrame:
    out = team_rows.select(*(c for c in team_rows.columns if c != "team"), "team.season", F.posexplode("team.games").alias("game_index", "g"))
    return out.withColumn("opponent", T.squeeze(F.col("g.opponent"))).where("opponent <> ''").select(*(c for c in out.columns if c != "g"), "opponent", F.col("g.date").alias("game_date"), "g.result", "g.venue")


def records(team_rows: DataFrame) -> DataFrame:
    out = team_rows.select(*(c for c in team_rows.columns if c != "team"), "team.season", F.posexplode("team.records").alias("record_index", "r"))
    kind = F.coalesce(F.nullif(T.squeeze(F.col("r.type")), F.lit("")), F.nullif(T.squeeze(F.col("r.record_type")), F.lit("")))
    return out.withColumn("record_type", kind).withColumn("value", T.squeeze(F.col("r.value"))).where("record_type is not null and value <> ''").drop("r")


def handbook_sections(pages: DataFrame, version: str, by: list[str] | None = None) -> DataFrame:
    """Sections of marked pages (page, page_text): the first line as title; extraction quality by the share of letters over all pages."""
    by = by or []
    alpha = pages.groupBy(*by).agg((F.sum(T.letters(F.col("page_text"))) / F.greatest(F.sum(F.length("page_text")) + F.count(F.lit(1)) - 1, F.lit(1))).alias("_alpha"))
    quality = F.when(F.col("_alpha") >= 0.6, "native").otherwise("degraded")
    joined = pages.join(alpha, by) if by else pages.withColumn("_alpha", F.lit(alpha.first()[0]))
    title = T.squeeze(F.split(F.col("page_text"), T.LINE_END)[0])
    rows = joined.where(T.squeeze(F.col("page_text")) != "").withColumn("section_title", title).withColumn("extraction_quality", quality)
    return rows.withColumn("text", T.squeeze(F.col("page_text"))).withColumn("section_key", T.slug(F.concat(F.lit(f"{version}-"), F.col("section_title"), F.lit("-"), F.col("page").cast("string")))).withColumn("citation_label", F.concat(F.lit(f"{version}, page "), F.col("page").cast("string"))).drop("_alpha", "page_text")


def family_metrics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_family, documents, chunks)."""
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    return documents.join(c, documents["id"] == c["document_id"], "left").groupBy("source_family").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"))
