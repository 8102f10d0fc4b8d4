"""The standards audit: what is wrong with each document, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DOC_TYPES, LEGACY_STATUS, MAX_CHUNK_CHARS, REQUIRED_FIELDS, STATUSES, RenameMap
from ..functions.text import lines, strip
from ..sources.shared import written
from .frontmatter import strict_yaml

#: A document's name: area, type and title.
FILE_NAME = rf"\A(\d{{2}})-({'|'.join(DOC_TYPES)})-[a-z0-9-]+\.md\z"

# Categories in the order in which they are tried, and what a message of each holds.
CATEGORIES = (
    ("filename-pattern", lambda m: m.contains("filename")),
    ("frontmatter-parse", lambda m: m.contains("frontmatter") & m.contains("parse")),
    ("frontmatter-missing", lambda m: m.contains("no frontmatter") | m.contains("not closed")),
    ("missing-fields", lambda m: m.startswith("missing required frontmatter")),
    ("file-mismatch", lambda m: m.contains("`file` field")),
    ("type-invalid", lambda m: m.contains("`type`")),
    ("status-invalid", lambda m: m.contains("`status`")),
    ("area-invalid", lambda m: m.contains("`area`")),
    ("date-format", lambda m: m.contains("`date`")),
    ("field-type", lambda m: m.contains("must be a list")),
    ("no-h2", lambda m: m.contains("no `##`")),
    ("deep-nesting", lambda m: m.contains("deeper than")),
    ("oversized-section", lambda m: m.contains("exceed 4000")),
    ("dangling-ref", lambda m: m.contains("does not match any existing")),
    ("area-ref-malformed", lambda m: m.contains("area ref")),
)


def categorize(message: Column) -> Column:
    out = None
    for name, test in CATEGORIES:
        out = F.when(test(message), name) if out is None else out.when(test(message), name)
    return out.otherwise("other")


def _py_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def _value(k: str) -> Column:
    return F.try_element_at("y.fields", F.lit(k))


def frontmatter_issues() -> Column:
    """array<string> of what is wrong with the fields of (name, y)."""
    stem = F.regexp_replace("name", r"\.md\z", "")
    named = F.col("name").rlike(FILE_NAME)
    fn_area = F.when(named, F.regexp_extract("name", FILE_NAME, 1).cast("int"))
    fn_type = F.when(named, F.regexp_extract("name", FILE_NAME, 2))
    has = lambda k: _value(k).isNotNull()
    kind, text, shown = (lambda k, part=part: _value(k)[part] for part in ("kind", "text", "shown"))
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    tests = [F.when(~has(f), say(f"missing required frontmatter field `{f}`")) for f in REQUIRED_FIELDS]
    tests.append(F.when(has("file") & ((kind("file") != "text") | (text("file") != stem)), say("`file` field `", text("file"), "` does not match filename `", stem, "`")))
    tests.append(F.when(has("type") & ~text("type").isin(*DOC_TYPES), say("`type` `", text("type"), f"` not in allowed set {_py_list(DOC_TYPES)}")).when(has("type") & (fn_type != text("type")), say("`type` `", text("type"), "` does not match filename type `", fn_type, "`")))
    tests.append(F.when(has("status") & ~text("status").isin(*STATUSES), say("`status` `", text("status"), f"` not in allowed set {_py_list(STATUSES)}")))
    number = _value("area")["number"]
    tests.append(F.when(has("area") & (kind("area") != "int"), say("`area` must be integer, got `", shown("area"), "`")).when(has("area") & ~F.coalesce(number.between(0, 12), F.lit(False)), say("`area` `", text("area"), "` out of range 0, 12")).when(has("area") & (number != fn_area), say("`area` `", text("area"), "` does not match filename area `", fn_area.cast("string"), "`")))
    tests.append(F.when(has("date") & (kind("date") != "date") & ~((kind("date") == "text") & text("date").rlike(r"\A\d{4}-\d{2}-\d{2}\z")), say("`date` `", shown("date"), "` not in YYYY-MM-DD format")))
    tests += [F.when(has(r) & ~kind(r).isin("null", "list"), say(f"`{r}` must be a list (use `[]` if empty)")) for r in ("depends-on", "feeds-into")]
    return F.array_compact(F.array(*tests))


def with_sections(docs: DataFrame, body: Column) -> DataFrame:
    """Adds what section_issues() looks at. Step by step, so that each text is split once."""
    d = docs.withColumn("rows_", lines(body))
    d = d.withColumn("h2_", F.size(F.filter("rows_", lambda x: x.startswith("## ")))).withColumn("deep_", F.size(F.filter("rows_", lambda x: x.rlike(r"\A#{4,}\s"))))
    # sections with their heading lines; a line end that closes a section belongs to none
    d = d.withColumn("parts_", F.split(F.array_join("rows_", "\n"), r"(?m)(?=^## )", -1)).drop("rows_")
    size = lambda p, i: (F.length(p) - F.when((i < F.size("parts_") - 1) & p.endswith("\n"), 1).otherwise(0)).alias("n")
    head = lambda p: F.when(p.startswith("## "), strip(F.regexp_extract(p, r"\A([^\n]*)", 1))).otherwise("(preamble)").alias("h")
    return d.withColumn("big_", F.filter(F.transform("parts_", lambda p, i: F.struct(head(p), size(p, i))), lambda s: s["n"] > MAX_CHUNK_CHARS)).drop("parts_")


def section_issues(exempt_h2: Column, exempt_deep: Column, exempt_size: Column) -> Column:
    """array<string> of what is wrong with headings and section lengths (a section counts with its heading line)."""
    some = F.array_join(F.transform(F.slice("big_", 1, 3), lambda s: F.concat(F.lit("'"), F.substring(s["h"], 1, 60), F.lit("'="), s["n"].cast("string"), F.lit("ch"))), ", ")
    more = F.when(F.size("big_") > 3, F.concat(F.lit(" (+"), (F.size("big_") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return F.array_compact(
        F.array(
            F.when((F.col("h2_") == 0) & ~exempt_h2, "no `##` section headers (document is a single chunk)"),
            F.when((F.col("deep_") > 0) & ~exempt_deep, F.concat(F.lit("has "), F.col("deep_").cast("string"), F.lit(" header(s) nested deeper than `###`"))),
            F.when((F.col("h2_") > 0) & (F.size("big_") > 0) & ~exempt_size, F.concat(F.size("big_").cast("string"), F.lit(" section(s) exceed 4000 chars: "), some, more)),
        )
    )


def audit(docs: DataFrame, exempt_h2: tuple = (), exempt_deep: tuple = (), exempt_size: tuple = ()) -> DataFrame:
    """docs (name, text) of one flat folder -> name, message, category: a row for each violation.

    Tracker notes and the index are skipped. A document whose frontmatter can't be read is checked no further."""
    d = docs.select("name", "text").filter(~F.col("name").startswith("track-") & (F.col("name") != "index.md")).withColumn("y", strict_yaml(F.col("text")))
    bad_name = F.when(~F.col("name").rlike(FILE_NAME), "filename does not match `[NN]-[type]-[name].md` pattern")
    # the body starts after the line that closes the block
    d = with_sections(d, F.substring("text", F.locate("\n---", F.col("text"), 4) + 4, F.length("text"))).drop("text")
    among = lambda names: F.col("name").isin(*names) if names else F.lit(False)
    refs = F.transform("y.refs", lambda r: F.struct(r["rel"].alias("rel"), r["ref"].alias("ref"), _ref_issue(r).alias("message")))
    lost = F.filter(refs, lambda r: r["message"].isNull() & ~r["ref"].startswith("area-"))
    inner = F.concat(frontmatter_issues(), section_issues(among(exempt_h2), among(exempt_deep), among(exempt_size)), F.array_compact(F.transform(refs, lambda r: r["message"])))
    d = d.select("name", F.concat(F.array_compact(F.array(bad_name, F.col("y.error"))), F.when(F.col("y.error").isNull(), inner).otherwise(F.array().cast("array<string>"))).alias("issues"), lost.alias("lost"))
    # references to documents that don't exist: an anti join, in the same pass over the texts as all else
    rows = d.select("name", F.explode(F.concat(F.transform("issues", lambda m: F.struct(F.lit(None).cast("string").alias("ref"), m.alias("message"))), F.transform("lost", lambda r: F.struct(r["ref"].alias("ref"), F.concat(F.lit("`"), r["rel"], F.lit("` ref `"), r["ref"], F.lit("` does not match any existing doc")).alias("message"))))).alias("m")).select("name", "m.*")
    known = docs.select(F.regexp_replace("name", r"\.md\z", "").alias("ref")).distinct()
    return rows.join(known, "ref", "left_anti").select("name", "message").withColumn("category", categorize(F.col("message")))


def _ref_issue(r: Column) -> Column:
    """What is wrong with an entry in itself: it is no text, or a misshapen area reference."""
    odd = F.concat(F.lit("`"), r["rel"], F.lit("` entry `"), r["ref"], F.lit("` is not a string"))
    area = F.concat(F.lit("`"), r["rel"], F.lit("` area ref `"), r["ref"], F.lit("` malformed (expected `area-N-name`)"))
    return F.when(~r["is_text"], odd).when(r["ref"].startswith("area-") & ~r["ref"].rlike(r"\Aarea-\d+-[a-z0-9-]+\z"), area)


def by_category(violations: DataFrame) -> DataFrame:
    return violations.groupBy("category").agg(F.countDistinct("name").alias("files"))


def ranked_categories(violations: DataFrame) -> DataFrame:
    """Categories with the files that have them and their place, the most first. They are few, so one window does."""
    place = F.row_number().over(Window.orderBy(F.desc("files"), "category"))
    return by_category(violations).withColumn("place", place)


def totals(docs: DataFrame, violations: DataFrame) -> DataFrame:
    bad = violations.select("name").distinct().withColumn("bad", F.lit(1))
    return docs.join(bad, "name", "left").agg(F.count("*").alias("total"), F.count_if(F.col("bad").isNull()).alias("clean"), F.count("bad").alias("violating"))


def report_head(docs: DataFrame, violations: DataFrame) -> str:
    """The report down to its table of categories: of any collection, since little of it is collected. violations are gone
    over twice, so a table of them is better than a plan that works them out."""
    t = totals(docs, violations).first()
    out = ["# Standards audit", "", f"- Total: {t.total}", f"- Clean: {t.clean}", f"- With violations: {t.violating}", "", "## Categories", "", "| Category | Files |", "|---|---|"]
    return "\n".join([*out, *(f"| {r.category} | {r.files} |" for r in ranked_categories(violations).orderBy("place").collect())]) + "\n"


def report(docs: DataFrame, violations: DataFrame) -> str:
    """The findings as markdown; what it lists is collected, so it is for collections that people read. They are worked out
    once."""
    violations = written(violations, "violations")
    out = [report_head(docs, violations), "## Violations"]
    for r in violations.groupBy("name").agg(F.array_sort(F.collect_list("message")).alias("m")).orderBy("name").collect():
        out += ["", f"### {r['name']}", "", *(f"- {m}" for m in r.m)]
    clean = docs.join(violations, "name", "left_anti").select("name").orderBy("name").collect()
    return "\n".join([*out, "", "## Clean files", "", *(f"- {r['name']}" for r in clean)]) + "\n"


def rewritten(ref: Column, name: Column, renames: RenameMap) -> Column:
    """A reference after the rename map; null where it is to go. Deletions come before a file's own renames,
    those before general ones, those before area redirects."""
    table = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) if m else F.create_map().cast("map<string,string>")
    own = F.create_map(*(x for f, m in renames.per_file_renames.items() for x in (F.lit(f), table(m)))) if renames.per_file_renames else F.create_map().cast("map<string,map<string,string>>")
    found = F.coalesce(F.try_element_at(F.try_element_at(own, name), ref), F.try_element_at(table(renames.renames), ref), F.try_element_at(table(renames.area_redirects), ref), ref)
    return F.when(ref.isin(*renames.delete_refs) if renames.delete_refs else F.lit(False), None).otherwise(found)


def fixed(docs: DataFrame, renames: RenameMap = RenameMap()) -> DataFrame:
    """docs (name, text) -> name, new_text, changed: legacy statuses, a wrong `file` field, and references in block
    lists under depends-on and feeds-into brought in line. Nothing is written."""
    block = r"(?s)\A(---\s*\n)(.*?)(\n---)"
    raw = F.regexp_extract("text", block, 2)
    rows = F.split(raw, "\n", -1)
    stem = F.regexp_replace("name", r"\.md\z", "")
    keys = F.transform(rows, lambda x, i: F.element_at(F.filter(F.transform(F.slice(rows, F.lit(1), i + 1), lambda y: F.when(y.rlike(r"\A[A-Za-z][\w-]*\s*:"), F.regexp_extract(y, r"\A([A-Za-z][\w-]*)", 1))), lambda k: k.isNotNull()), -1))

    def line(x: Column, key: Column) -> Column:
        status = F.regexp_extract(x, r"\Astatus:\s*[\"']?(.*?)[\"']?\s*\z", 1)
        legacy = F.create_map(*(F.lit(v) for kv in LEGACY_STATUS.items() for v in kv))
        item = F.regexp_extract(x, r"\A\s*- \s*[\"']?(.*?)[\"']?\s*\z", 1)
        lead = F.regexp_extract(x, r"\A(\s*- \s*)", 1)
        new = rewritten(item, F.col("name"), renames)
        in_list = key.isin("depends-on", "feeds-into") & x.rlike(r"\A\s*- ")
        return F.when(x.startswith("status:") & F.try_element_at(legacy, status).isNotNull(), F.concat(F.lit("status: "), F.try_element_at(legacy, status))).when(x.startswith("file:"), F.when(strip(F.regexp_replace(x, r"\Afile:", "")) != stem, F.concat(F.lit("file: "), stem)).otherwise(x)).when(in_list & new.isNull(), None).when(in_list & (new != item), F.concat(lead, new)).otherwise(x)

    new_rows = F.array_compact(F.zip_with(rows, keys, line))
    out = F.when(F.col("text").rlike(block), F.concat(F.regexp_extract("text", block, 1), F.array_join(new_rows, "\n"), F.substring("text", F.length(F.regexp_extract("text", block, 1)) + F.length(raw) + 1, F.length("text")))).otherwise(F.col("text"))
    return docs.select("name", out.alias("new_text"), (out != F.col("text")).alias("changed"))
