"""Text Columns: normalisation, predicates, labels and wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrid.functions.codes import contains_any

# Display labels of known fields and units.
FIELD_LABELS = {
    "site_address": "Site Address",
    "postcode": "Postcode",
    "application_ref": "Application Reference",
    "applicant_name": "Applicant Name",
    "agent_name": "Agent Name",
    "agent_company": "Agent Company",
    "proposed_use": "Proposed Use",
    "development_description": "Development Description",
    "certificate_type": "Ownership Certificate",
    "certificate_date": "Certificate Date",
    "fee_amount": "Application Fee",
    "fee_paid": "Fee Payment Status",
    "fee_exemption": "Fee Exemption",
    "property_type": "Property Type",
    "existing_use": "Existing Use",
    "floor_area": "Floor Area",
    "site_area": "Site Area",
    "measurements": "Measurements",
    "height": "Height",
    "width": "Width",
    "depth": "Depth",
    "distance_from_boundary": "Distance from Boundary",
    "distance_from_watercourse": "Distance from Watercourse",
    "heritage_asset": "Heritage Asset",
    "conservation_area": "Conservation Area",
    "listed_building": "Listed Building",
    "tree_preservation_order": "Tree Preservation Order",
    "flood_zone": "Flood Zone",
    "parking_spaces": "Parking Spaces",
    "parking_existing": "Existing Parking",
    "parking_proposed": "Proposed Parking",
    "materials": "Materials",
    "design_style": "Design Style",
    "scale_ratio": "Scale Ratio",
    "proposal_date": "Proposal Date",
    "submission_date": "Submission Date",
}
UNIT_LABELS = {
    "m": "metres",
    "sqm": "square metres",
    "cm": "centimetres",
    "mm": "millimetres",
    "ha": "hectares",
    "ft": "feet",
    "stories": "storeys",
}

# Action guidance by words in a finding's message, first match wins.
GUIDANCE = [
    (["missing required field"], "Please ensure this information is included in your application documents."),
    (["missing document", "document required"], "Please upload the required document to proceed."),
    (["inconsistent", "mismatch"], "Please verify and correct the inconsistent information."),
    (["heritage", "conservation", "tpo", "flood"], "This may require additional assessment. Please review the details."),
    (["measurement"], "Please provide accurate measurements with units."),
    (["fee"], "Please confirm the application fee amount."),
    (["certificate"], "Please complete the ownership certificate section."),
]
DEFAULT_GUIDANCE = "Please review this item and take appropriate action."

# Words that mark noise and authority contact details.
NOISE_WORDS = ["copyright", "notes:", "scale", "printed on", "os 1000", "disclaimer", "this drawing", "for information only"]
COUNCIL_WORDS = ["birmingham.gov.uk", "planning.registration", "council", "local authority", "planning department", "planning@", "0121 464", "po box"]

# Patterns of form labels that are not values.
FORM_LABEL_PATTERNS = [
    r"\bfirst\s*name\b", r"\bsurname\b", r"\blast\s*name\b", r"\bmiddle\s*name\b",
    r"\btitle\b", r"\bmr\b", r"\bmrs\b", r"\bmiss\b", r"\bms\b", r"\bdr\b",
    r"\bunselected:\s*yes\b", r"\b:selected:\s*no\b", r"\bunselected\b", r"\b:selected\b",
]

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _lookup(mapping: dict[str, str], col: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), col)


def norm(col: Column) -> Column:
    """Runs of any white space become one blank; ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), _SPACE, " "))


def normalise_label(col: Column) -> Column:
    return norm(F.translate(F.lower(col), "_-:", "  "))


def looks_all_caps(col: Column) -> Column:
    letters = F.length(F.regexp_replace(col, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(col, r"[^\p{Lu}]", ""))
    return (letters >= 8) & (upper / F.greatest(letters, F.lit(1)) > 0.8)


def is_noise(lowered: Column) -> Column:
    return contains_any(lowered, NOISE_WORDS)


def is_council_contact(lowered: Column) -> Column:
    return contains_any(lowered, COUNCIL_WORDS)


def _any(patterns: list[str]) -> str:
    return "(?iU)(?:" + "|".join(patterns) + ")"


def is_form_label(col: Column) -> Column:
    return col.rlike(_any(FORM_LABEL_PATTERNS))


def clean_value(col: Column, field_name: str) -> Column:
    """Remove form labels, titles and checkbox marks from an extracted value."""
    value = col
    for pattern in FORM_LABEL_PATTERNS:
        value = F.regexp_replace(value, "(?iU)" + pattern, "")
    if "name" in field_name:
        value = F.regexp_replace(value, r"(?iU)\b(Mr|Mrs|Miss|Ms|Dr)\.?\s*", "")
        value = F.when(F.trim(value).rlike(r"(?iU)^(surname|first\s*name|last\s*name)$"), "").otherwise(value)
    if "description" in field_name or "proposal" in field_name:
        for pattern in (r"\bunselected:\s*\w+\s*:?selected:\s*\w+\b", r"\b:?selected:\s*\w+\b", r"\bunselected:\s*\w+\b"):
            value = F.regexp_replace(value, "(?iU)" + pattern, "")
    return norm(value)


def snippet(col: Column, limit: int = 100) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))).otherwise(col)


def title_case(col: Column) -> Column:
    return F.initcap(F.translate(col, "_", " "))


def field_label(col: Column) -> Column:
    return F.coalesce(_lookup(FIELD_LABELS, col), title_case(col))


def format_scalar(value: Column, unit: Column | None = None) -> Column:
    """Shown form of a stored value: missing, flag, number with its unit in words, or the text itself."""
    shown = value
    if unit is not None:
        worded = F.concat_ws(" ", value, F.coalesce(_lookup(UNIT_LABELS, unit), unit))
        shown = F.when(value.try_cast("double").isNotNull() & (F.coalesce(unit, F.lit("")) != ""), worded).otherwise(value)
    flag = F.when(value.isin("True", "true"), "Yes").when(value.isin("False", "false"), "No")
    return F.when(value.isNull(), "Not provided").otherwise(F.coalesce(flag, shown))


def format_measurement(item: Column) -> Column:
    """`8.5 metres (height)`, or with the raw text where the context is unknown."""
    unit = F.coalesce(_lookup(UNIT_LABELS, item["unit"]), item["unit"])
    known = item["context"].isNotNull() & ~item["context"].isin("", "unknown")
    tail = F.when(known, F.concat(F.lit(" ("), item["context"], F.lit(")"))).when(
        F.coalesce(item["raw_text"], F.lit("")) != "", F.concat(F.lit(" (from: "), item["raw_text"], F.lit(")"))
    )
    return F.concat(item["value"].cast("string"), F.lit(" "), unit, F.coalesce(tail, F.lit("")))


def format_measurements(items: Column) -> Column:
    bullets = F.transform(items, lambda m: F.concat(F.lit("• "), format_measurement(m)))
    return F.when(F.size(items) == 0, "None").otherwise(F.array_join(bullets, "\n"))


def format_json(value: Column) -> Column:
    """A stored JSON measurement, list of measurements or plain list as readable text; other text unchanged."""
    kind = "struct<value:string,unit:string,context:string,raw_text:string>"
    fixed = F.translate(value, "'", '"')
    trimmed = F.trim(value)
    one, many, plain = (F.from_json(fixed, k) for k in (kind, f"array<{kind}>", "array<string>"))
    is_object = trimmed.startswith("{") & trimmed.endswith("}") & one["value"].isNotNull() & one["unit"].isNotNull()
    is_list = trimmed.startswith("[") & trimmed.endswith("]")
    measured = is_list & (F.size(many) > 0) & F.forall(many, lambda m: m["value"].isNotNull() & m["unit"].isNotNull())
    return (
        F.when(is_object, format_measurement(one))
        .when(measured, format_measurements(many))
        .when(is_list & (F.size(plain) == 0), "None")
        .when(is_list & plain.isNotNull(), F.array_join(plain, ", "))
        .otherwise(value)
    )


def action_guidance(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    result = F.lit(DEFAULT_GUIDANCE)
    for words, text in reversed(GUIDANCE):
        result = F.when(contains_any(lowered, words), F.lit(text)).otherwise(result)
    return result


def friendly_message(message: Column) -> Column:
    """Technical field names in a missing-fields message replaced by their labels."""
    listed = F.regexp_extract(message, r"Missing required fields?: (.+)", 1)
    labels = F.transform(F.split(listed, ","), lambda f: field_label(F.trim(f)))
    return F.when(listed != "", F.concat(F.lit("Missing required information: "), F.array_join(labels, ", "))).otherwise(message)


def split_list(col: Column) -> Column:
    """Split on commas, semicolons and bars; blanks dropped."""
    return F.filter(F.transform(F.split(col, r"[,;|]+"), lambda x: F.trim(x)), lambda x: x != "")
