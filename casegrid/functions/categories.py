"""Display categories of fields: the first category that lists a field, else Uncategorised. Fixed values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD_CATEGORIES = {
    "Application Details": ["application_ref", "application_date", "decision_date", "certificate_type", "fee_amount"],
    "Site & Applicant": ["site_address", "postcode", "applicant_name", "agent_name"],
    "Development Details": ["proposed_use", "existing_use", "development_type", "proposal_description", "floor_area", "site_area", "num_dwellings", "num_bedrooms", "building_height", "watercourse_proximity", "num_parking_spaces"],
    "Constraints": ["heritage_asset", "listed_building", "conservation_area", "tree_preservation_order", "flood_zone"],
    "Plans & Drawings": ["north_arrow_present", "measurements"],
}


def categorised(fields: DataFrame) -> DataFrame:
    pairs = {}
    for category, names in FIELD_CATEGORIES.items():
        for name in names:
            pairs.setdefault(name, category)
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return fields.withColumn("category", F.coalesce(F.try_element_at(table, F.col("field_name")), F.lit("Uncategorised")))
