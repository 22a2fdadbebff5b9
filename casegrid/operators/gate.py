"""Outside resolvers: which documents to send, what to send, and how answers come back.

The engine makes no remote call. It writes request rows and joins response rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions import text as X
from casegrid.functions.codes import ratio
from casegrid.functions.rule_catalog import FIELD_OWNERSHIP
from casegrid.operators.ordered import latest

HEADING_ROLES = ["title", "sectionHeading"]
MINIMUM_BLOCKS = 5

# What to look for when a field's context is chosen.
FIELD_HINTS = {
    "site_address": "Look for address information, postcodes, street names",
    "proposed_use": "Look for descriptions of proposed development, use classes",
    "application_ref": "Look for application reference numbers, planning references",
}
TASK = "Fill missing structured fields from extracted evidence only. If not found, return null."


def _owned(document_type: Column) -> Column:
    pairs = [x for name, fields in FIELD_OWNERSHIP.items() for x in (F.lit(name), F.array(*[F.lit(f) for f in fields]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), document_type), F.array().cast("array<string>"))


def trigger(findings: DataFrame, documents: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Per document: whether a resolver is worth asking and for which fields.

    ``findings``: document_id, status, severity, rule_severity, missing_fields. ``documents``: document_id,
    document_type, block_count. ``resolved``: document_id, resolved_fields array.
    """
    open_error = (F.col("severity") == "error") & F.col("status").isin("needs_review", "fail")
    needs = F.bool_or(F.col("status").isin("needs_review", "fail") & (F.col("rule_severity") == "error"))
    wanted = findings.groupBy("document_id").agg(
        needs.alias("needs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(open_error, F.col("missing_fields")))))).alias("missing"),
    )
    joined = documents.join(wanted, "document_id", "left")
    known = F.array().cast("array<string>")
    if resolved is not None:
        joined = joined.join(resolved, "document_id", "left")
        known = F.coalesce("resolved_fields", known)
    asked = F.array_intersect(F.array_except(F.coalesce("missing", F.array().cast("array<string>")), known), _owned(F.col("document_type")))
    fires = F.coalesce("needs", F.lit(False)) & (F.size(asked) > 0) & (F.col("block_count") >= MINIMUM_BLOCKS)
    return joined.select("document_id", "document_type", fires.alias("triggered"), asked.alias("asked_fields"))


def _role(b: Column) -> Column:
    return F.coalesce(b["role"], F.lit("")).isin(HEADING_ROLES)


def document_context(blocks: Column, tables: Column | None = None, max_chars: int = 6000, max_blocks: int = 80) -> Column:
    """Bounded text for a resolver: headings first, then blocks in order, until the character budget is met."""
    ordered = F.concat(F.filter(blocks, _role), F.filter(blocks, lambda b: ~_role(b)))
    shown = F.filter(F.slice(ordered, 1, max_blocks), lambda b: F.coalesce(b["content"], F.lit("")) != "")
    parts = F.transform(shown, lambda b: F.when(_role(b), F.concat(F.lit("## "), b["content"])).otherwise(b["content"]))
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("text"))

    def add(acc: Column, part: Column) -> Column:
        grown = F.struct(
            (acc["used"] + F.length(part)).alias("used"),
            F.when(acc["text"] == "", part).otherwise(F.concat(acc["text"], F.lit("\n\n"), part)).alias("text"),
        )
        return F.when(acc["used"] >= max_chars, acc).otherwise(grown)

    filled = F.aggregate(parts, start, add)
    if tables is not None:
        lines = F.transform(
            F.slice(tables, 1, 10),
            lambda t: F.array_join(F.filter(F.transform(F.slice(t["cells"], 1, 30), lambda c: c["content"]), lambda x: F.coalesce(x, F.lit("")) != ""), " | "),
        )
        filled = F.aggregate(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x != ""), filled, add)
    return F.substring(filled["text"], 1, max_chars)


def field_context(blocks: Column, field_name: str, max_chars: int = 4000, max_blocks: int = 30) -> Column:
    """Blocks that mention most of a field's keywords, best first, within a character budget."""
    hint = FIELD_HINTS.get(field_name, "")
    keywords = [field_name.replace("_", " "), *hint.lower().split()]

    def score(b: Column) -> Column:
        lowered = F.lower(F.coalesce(b["content"], F.lit("")))
        total = F.lit(0)
        for word in keywords:
            total = total + lowered.contains(word).cast("int")
        return total

    ranked = F.array_sort(F.transform(blocks, lambda b, i: F.struct((-score(b)).alias("s"), i.alias("i"), b["content"].alias("c"))))
    chosen = F.filter(F.transform(F.slice(ranked, 1, max_blocks), lambda x: x["c"]), lambda c: F.coalesce(c, F.lit("")) != "")
    body = F.substring(F.array_join(chosen, "\n\n"), 1, max_chars)
    return F.concat(F.lit(hint + "\n\n"), body) if hint else body


def requests(triggered: DataFrame) -> DataFrame:
    """One request payload per document that needs one: only the missing fields are asked for."""
    payload = F.struct(F.lit(TASK).alias("task"), F.col("asked_fields").alias("missing_fields"))
    return triggered.where("triggered").select("document_id", "asked_fields", F.to_json(payload).alias("payload"))


def apply_responses(fields: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers fill absent fields only; an empty answer changes nothing.

    Both: document_id, field_name, value, confidence.
    """
    given = responses.where(F.coalesce(F.col("value") != "", F.lit(False))).select(
        "document_id", "field_name", "value", "confidence", F.lit(0).alias("own")
    )
    own = fields.select("document_id", "field_name", "value", "confidence", F.lit(1).alias("own"))
    order = [F.col("own"), F.coalesce("confidence", F.lit(-1.0)), F.col("value")]
    return latest(own.unionByName(given), ["document_id", "field_name"], order, ["value", "confidence", "own"]).select(
        "document_id", "field_name", "value", "confidence", F.when(F.col("own") == 1, "extraction").otherwise("resolver").alias("origin")
    )


def resolver_status(value: Column, confidence: Column, threshold: float = 0.7) -> Column:
    """Status after an answer: pass from the threshold on, review below it, fail without a value."""
    empty = F.coalesce(value, F.lit("")) == ""
    return F.when(empty, "fail").when(confidence >= threshold, "pass").otherwise("needs_review")


def low_confidence(evidence: DataFrame, threshold: float = 0.7) -> DataFrame:
    """First evidence below the threshold per document and field."""
    low = evidence.where(F.col("confidence") < threshold)
    return low.groupBy("doc_id", "field_name").agg(
        F.min(F.struct("pos", "confidence", "snippet")).alias("e")
    ).select("doc_id", "field_name", "e.confidence", "e.snippet")


def extraction_kpis(documents: DataFrame) -> DataFrame:
    """One row of extraction figures. ``documents``: document_type, application_ref, applicant_email, triggered, clean."""
    is_form = F.col("document_type") == "application_form"
    found = F.coalesce(F.col("application_ref") != "", F.lit(False))
    council = F.lower(F.coalesce("applicant_email", F.lit(""))).endswith("birmingham.gov.uk")
    agg = documents.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(is_form).alias("forms"),
        F.count_if(is_form & found).alias("forms_with_ref"),
        F.count_if(council).alias("council_email_hits"),
        F.count_if("triggered").alias("triggers"),
    )
    return agg.select(
        "total_docs",
        F.round(ratio(F.col("forms_with_ref"), F.col("forms")), 6).alias("application_ref_rate"),
        "council_email_hits",
        F.round(ratio(F.col("triggers"), F.col("total_docs")), 6).alias("trigger_rate"),
    )


def pass_rate_by_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.count_if("clean") / F.count(F.lit(1)), 6).alias("pass_rate")
    )


def outcome_histogram(summaries: DataFrame) -> DataFrame:
    """How many documents share each `P:x R:y F:z` outcome."""
    key = F.format_string("P:%d R:%d F:%d", F.col("pass"), F.col("needs_review"), F.col("fail"))
    return summaries.groupBy(key.alias("outcome")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("needs_llm").alias("needing_resolver")
    )


# ---- chunking ----------------------------------------------------------------------------------


def token_chunks(df: DataFrame, text: str, *keys: str, size: int = 300, overlap: int = 100) -> DataFrame:
    """Overlapping windows of white-space tokens over the whole text, inside the row."""
    tokens = F.filter(F.split(X.norm(F.col(text)), " "), lambda x: x != "")
    staged = df.select(*keys, tokens.alias("__tokens"))
    count, step = F.size("__tokens"), size - overlap
    last = F.greatest(F.ceil((count - size) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    pieces = F.transform(
        starts,
        lambda s: F.struct(
            s.cast("bigint").alias("start_token"),
            F.size(F.slice("__tokens", s + 1, size)).cast("bigint").alias("n_tokens"),
            F.array_join(F.slice("__tokens", s + 1, size), " ").alias("chunk"),
        ),
    )
    return staged.where(count > 0).select(*keys, F.posexplode(pieces).alias("chunk_no", "p")).select(*keys, F.col("chunk_no").cast("bigint").alias("chunk_no"), "p.*")


# ---- keyword lookup (single-field rules) -------------------------------------------------------

ENTRY = "struct<label:string,value:string>"


def _lines(content: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def _shifted(lines: Column) -> Column:
    """The line after each line; lines are paired with it once, not looked up by number."""
    return F.slice(lines, F.lit(2), F.size(lines))


def label_entries(blocks: Column) -> Column:
    """Label/value pairs in reading order: `label: value` on one line, or a bare label with the next line."""

    def of_block(b: Column) -> Column:
        lines = _lines(b["content"])

        def entry(line: Column, next_line: Column) -> Column:
            label = F.trim(F.substring_index(line, ":", 1))
            value = F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
            following = F.coalesce(next_line, F.lit(""))
            bare = F.trim(F.substring(line, F.lit(1), F.length(line) - 1))
            same = line.contains(":") & (label != "") & (value != "")
            below = line.endswith(":") & (bare != "") & (following != "")
            return F.when(
                same, F.struct(X.normalise_label(label).alias("label"), value.alias("value"))
            ).when(below, F.struct(X.normalise_label(bare).alias("label"), following.alias("value")))

        return F.filter(F.zip_with(lines, _shifted(lines), entry), lambda e: e.isNotNull())

    return F.coalesce(F.flatten(F.transform(blocks, of_block)), F.array().cast(f"array<{ENTRY}>"))


def label_index(layouts: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, value): the last value written for a label wins."""
    entries = layouts.select(*keys, F.posexplode(label_entries(F.col("text_blocks"))).alias("n", "e"))
    return latest(entries.select(*keys, "n", "e.*"), [*keys, "label"], [F.col("n")], ["value"])


def _line_value(word: str):
    """Value on a line whose label holds ``word``, or the next line after a line that is just ``word``."""

    def read(x: Column) -> Column:
        value = F.trim(F.regexp_extract(x["line"], r"^[^:]*:(.*)$", 1))
        labelled = F.lower(F.substring_index(x["line"], ":", 1)).contains(word) & x["line"].contains(":")
        alone = F.regexp_replace(F.trim(F.lower(x["line"])), ":+$", "") == word
        return F.coalesce(F.when(labelled & (value != ""), value), F.when(alone, F.nullif(F.trim(x["next"]), F.lit(""))))

    return read


def keyword_value(field_name: str, entries: Column, blocks: Column) -> Column:
    """Value of a field by keyword: exact label, label containing it, labelled line, then pattern over the text."""
    key = field_name.replace("_", " ")
    forms = list(dict.fromkeys([key, field_name.replace("_", "-"), field_name]))
    exact = F.get(F.transform(F.slice(F.reverse(F.filter(entries, lambda e: e["label"] == key)), 1, 1), lambda e: e["value"]), 0)
    first = F.get(F.filter(entries, lambda e: e["label"].contains(key)), 0)["label"]
    partial = F.get(F.transform(F.slice(F.reverse(F.filter(entries, lambda e: e["label"] == first)), 1, 1), lambda e: e["value"]), 0)
    candidates = [exact, partial]

    def paired(b: Column) -> Column:
        own = F.split(F.coalesce(b["content"], F.lit("")), r"\r\n|\n|\r")
        both = F.zip_with(own, _shifted(own), lambda line, following: F.struct(line.alias("line"), following.alias("next")))
        return F.filter(both, lambda x: x["line"].isNotNull())

    lines = F.flatten(F.transform(blocks, paired))
    for word in forms:
        candidates.append(F.get(F.filter(F.transform(lines, _line_value(word)), lambda v: v.isNotNull()), 0))
    whole = F.array_join(F.filter(F.transform(blocks, lambda b: b["content"]), lambda c: F.coalesce(c, F.lit("")) != ""), "\n")
    for word in forms:
        for pattern in (rf"{word}:\s*([^\n]+)", rf"{word}\s+([^\n]+)"):
            candidates.append(F.nullif(F.trim(F.regexp_extract(whole, "(?iU)" + pattern, 1)), F.lit("")))
    return F.coalesce(*candidates)


def evidence_page(value: Column, blocks: Column) -> Column:
    """Page of the first block that contains the value, ignoring case."""
    holding = F.filter(blocks, lambda b: F.lower(F.coalesce(b["content"], F.lit(""))).contains(F.lower(value)))
    return F.when(F.coalesce(value, F.lit("")) != "", F.get(F.transform(F.slice(holding, 1, 1), lambda b: b["page_number"]), 0))


# Single-field rules applied when no catalogue is given.
FIELD_RULES = [
    {"field": "site_address", "name": "Site Address Validation", "required": True, "min_length": 10},
    {"field": "proposed_use", "name": "Proposed Use Validation", "required": True},
    {"field": "application_ref", "name": "Application Reference Format", "required": True, "pattern": r"APP/\d{4}/\d+"},
]


def single_field_checks(layouts: DataFrame, *keys: str, rules: list[dict] | None = None) -> DataFrame:
    """Presence, pattern and length checks on values found by keyword; one row per document and rule."""
    staged = layouts.select(*keys, "text_blocks", label_entries(F.col("text_blocks")).alias("__entries"))
    results = []
    for rule in rules if rules is not None else FIELD_RULES:
        name = rule["field"]
        found = f"__{name}"
        staged = staged.withColumn(found, keyword_value(name, F.col("__entries"), F.col("text_blocks")))
        value = F.col(found)
        length = F.length(value)
        missing = value.isNull()
        bad_pattern = ~value.rlike("(?iU)" + rule["pattern"]) if rule.get("pattern") else F.lit(False)
        short = length < rule["min_length"] if rule.get("min_length") else F.lit(False)
        long = length > rule["max_length"] if rule.get("max_length") else F.lit(False)
        status = (
            F.when(missing, "fail" if rule.get("required") else "pass").when(bad_pattern | short | long, "fail").otherwise("pass")
        )
        message = (
            F.when(missing, F.lit(f"Required field '{name}' not found" if rule.get("required") else None))
            .when(bad_pattern, f"Field '{name}' does not match required pattern")
            .when(short, f"Field '{name}' is too short (min: {rule.get('min_length')})")
            .when(long, f"Field '{name}' is too long (max: {rule.get('max_length')})")
        )
        confidence = (
            F.when(missing, 0.0 if rule.get("required") else 1.0).when(bad_pattern | short | long, 0.5).otherwise(0.8)
        )
        results.append(
            F.struct(
                F.lit(name).alias("field_name"),
                F.lit(rule["name"]).alias("rule_name"),
                status.alias("status"),
                value.alias("extracted_value"),
                message.alias("error_message"),
                confidence.alias("confidence"),
                F.when(status == "pass", evidence_page(value, F.col("text_blocks"))).alias("evidence_page"),
            )
        )
    return staged.select(*keys, F.inline(F.array(*results)))


# ---- issue records -----------------------------------------------------------------------------

# Document type by words that must all occur, first match wins.
DOCUMENT_WORDS = [
    ("ownership_certificate", ["ownership", "certificate"]),
    ("location_plan", ["location", "plan", "site plan"]),
    ("site_plan", ["site plan", "block plan"]),
    ("proposed_elevations", ["elevation", "proposed"]),
    ("existing_elevations", ["elevation", "existing"]),
    ("proposed_floor_plans", ["floor plan", "proposed"]),
    ("existing_floor_plans", ["floor plan", "existing"]),
    ("design_access_statement", ["design", "access", "statement"]),
    ("planning_statement", ["planning statement"]),
    ("heritage_statement", ["heritage", "statement"]),
    ("flood_risk_assessment", ["flood", "risk"]),
    ("ecological_assessment", ["ecological", "ecology", "biodiversity"]),
    ("tree_survey", ["tree", "survey", "arboricultural"]),
    ("transport_statement", ["transport", "traffic"]),
    ("noise_assessment", ["noise", "acoustic"]),
    ("air_quality_assessment", ["air quality"]),
    ("contaminated_land_assessment", ["contaminated", "land", "phase"]),
]


def requested_document(rule_id: Column, message: Column) -> Column:
    text = F.lower(F.concat_ws(" ", rule_id, message))
    result = F.lit(None).cast("string")
    for name, words in reversed(DOCUMENT_WORDS):
        every = F.lit(True)
        for word in words:
            every = every & text.contains(word)
        result = F.when(every, F.lit(name)).otherwise(result)
    return result


def issue_records(findings: DataFrame, run_id: Column, document_name: Column) -> DataFrame:
    """Findings as open issues with severity, category, first action and the rule to recheck."""
    lowered = F.lower(F.coalesce("rule_id", F.lit("unknown")))
    severity = F.when(F.col("status") == "fail", "critical").otherwise("warning")
    category = (
        F.when(lowered.contains("document") | lowered.contains("missing"), "missing_document")
        .when(lowered.contains("data") | lowered.contains("field"), "data_quality")
        .otherwise("other")
    )
    action = F.when(F.size("missing_fields") > 0, "provide_explanation").otherwise("review_evidence")
    return findings.select(
        F.concat_ws("_", run_id, F.col("rule_id"), document_name).alias("issue_id"),
        "rule_id",
        "status",
        severity.alias("severity"),
        category.alias("category"),
        action.alias("action"),
        requested_document(F.col("rule_id"), F.col("message")).alias("requested_document"),
        F.lit("open").alias("resolution_status"),
    )
