"""Parent discovery: references in text, address containment, shared postcodes, submission type.

Address containment is an exact substring join without a cross join: distinct candidate addresses
are indexed by short character runs and each distinct target address probes its rarest run only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.functions.codes import contains_any
from casegrid.operators.ordered import top_per_key
from casegrid.session import cut_lineage

# Reference formats tried in this order.
REFERENCE_PATTERNS = [r"APP[-/]?\d{4}[-/]?\d+", r"PP[-]?\d+", r"\d{8}[/-][A-Z]+", r"[A-Z]+[-/]?\d{4}[-/]?\d+"]

# Words that hint at the type of a submission.
RESUBMISSION_WORDS = ["resubmission", "following refusal", "following rejection", "resubmit"]
MODIFICATION_WORDS = [
    "amendment", "revised", "alteration", "extension", "change from",
    "modification", "variation", "amended", "change to", "increase", "decrease",
]

CANDIDATE_LIMIT = 10
#: Candidates of one character run that are read under one key.
SPLIT_ROWS = 10_000


def parent_reference(*texts: Column) -> Column:
    """First reference found: texts in order, formats in order within a text."""
    found = [F.nullif(F.regexp_extract(t, "(?iU)" + p, 0), F.lit("")) for t in texts for p in REFERENCE_PATTERNS]
    return F.coalesce(*found)


def similarity(target: Column, candidate: Column) -> Column:
    """Edit ratio of a text and a longer text that contains it, to two decimals."""
    return F.bround(F.lit(200.0) * F.length(target) / (F.length(target) + F.length(candidate))) / 100


def _grams(text: Column, size: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def containing_pairs(targets: DataFrame, candidates: DataFrame, gram: int = 8, least: float = 0.0, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(target, candidate, …) for distinct texts where the candidate contains the target, of at least that similarity.

    ``candidates`` has one row per ``candidate``; its other columns are handed on. The candidates of a frequent run
    are dealt into parts of some ``split_rows`` rows by their hash, and its targets visit each part: a run that all
    candidates share is many keys, whatever its frequency.
    """
    sized = targets.select("target").distinct().where(F.col("target") != "").withColumn("size", F.least(F.length("target"), F.lit(gram)))
    sizes = sized.agg(F.collect_set("size")).scalar()
    index = candidates.withColumn("size", F.explode(F.coalesce(sizes, F.array().cast("array<int>"))))
    index = index.withColumn("gram", F.explode(_grams(F.col("candidate"), F.col("size")))).drop("size")
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    probes = sized.select("target", F.explode(_grams(F.col("target"), F.col("size"))).alias("gram")).join(frequency, "gram", "left")
    rarest = probes.groupBy("target").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("p"))
    parts = F.ceil(F.col("p.uses") / split_rows)
    chosen = rarest.where(F.col("p.uses") > 0).select("target", F.col("p.gram").alias("gram"), parts.alias("parts"))
    chosen = cut_lineage(chosen)
    dealt = index.join(chosen.select("gram", "parts").distinct(), "gram")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("candidate"), F.col("parts"))).drop("parts")
    visits = chosen.select("target", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    alike = similarity(F.col("target"), F.col("candidate")) >= least
    return visits.join(dealt, ["gram", "part"]).where(alike & F.col("candidate").contains(F.col("target"))).drop("gram", "part")


def _newest_per_address(shortlist: DataFrame) -> DataFrame:
    """Each distinct address once, with its newest application."""
    return shortlist.where("rank = 1").select("candidate", F.col("created_at").alias("newest_at"), F.col("application_id").alias("newest_id"))


def _addresses(targets: DataFrame, applications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned targets (target_id, target, self) and candidates (application_id, candidate, created_at)."""
    cleaned = targets.where(F.col("address").isNotNull()).select(
        "target_id", F.lower(F.trim("address")).alias("target"), F.col("target_id").alias("self")
    )
    addressed = applications.where(F.col("site_address").isNotNull()).select(
        F.col("id").alias("application_id"), F.lower("site_address").alias("candidate"), "created_at"
    )
    # each task sorts what it reads by address; a file of one row group would be a single task
    return cleaned, addressed.repartition("application_id", "candidate")


def _best_others(cleaned: DataFrame, found: DataFrame, order: Sequence[Column], names: Sequence[str], limit: int) -> DataFrame:
    """(target_id, target, rank, …): the first ``limit`` applications of each target's addresses in ``order``, itself left out.

    ``found`` has a few rows per target. Targets with the same addresses share one short list, and each reads its own in
    place, so the matches of all targets are never sorted. Further copies of an address than ``limit`` change nothing.
    """
    dealt = cleaned.where(F.col("self").isNotNull()).repartition("target_id")
    copies = dealt.groupBy("target_id", "target").agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("copies"))
    asked = copies.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("target", "copies"))).alias("asked"))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(*order)))
    lists = asked.select("asked").distinct().select("asked", F.inline("asked")).join(ranked, "target")
    lists = lists.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    lists = lists.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*order, "target", "place", "copy")))
    lists = lists.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "target", *names))).alias("matches"))
    others = F.filter("matches", lambda m: m["application_id"] != F.col("target_id"))
    met = asked.join(lists, "asked").select("target_id", F.posexplode(F.slice(others, 1, limit)).alias("n", "m"))
    return met.select("target_id", (F.col("n") + 1).alias("rank"), "m.target", *[f"m.{name}" for name in names])


def closest_addresses(targets: DataFrame, applications: DataFrame, least: float = 0.9) -> DataFrame:
    """The most similar other application whose address contains the target's, over all of them; ties go to the newest.

    Every distinct address keeps its two newest applications, as one of them may be the target itself; a target keeps
    the two best addresses of each part it visits, by their newest application, before anything is shuffled.
    """
    cleaned, addressed = _addresses(targets, applications)
    newest = [F.col("created_at").desc(), F.col("application_id").desc()]
    shortlist = top_per_key(addressed, ["candidate"], newest, 2)
    pairs = containing_pairs(cleaned, _newest_per_address(shortlist), least=least)
    pairs = pairs.withColumn("similarity", similarity(F.col("target"), F.col("candidate")))
    best_addresses = [F.col("similarity").desc(), F.col("newest_at").desc(), F.col("newest_id").desc()]
    pairs = top_per_key(pairs, ["target"], best_addresses, 2).drop("rank", "newest_at", "newest_id")
    per_target = top_per_key(pairs.join(shortlist.drop("rank"), "candidate"), ["target"], [F.col("similarity").desc(), *newest], 2).drop("rank")
    best = _best_others(cleaned, per_target, [F.col("similarity").desc(), *newest], ["application_id", "similarity"], 1)
    return best.select("target_id", "application_id", "similarity")


def address_matches(targets: DataFrame, applications: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Up to ``limit`` newest applications whose address contains the target address, per target.

    ``targets``: target_id, address. An application never matches itself. The limit is part of the report;
    it is applied per distinct address first, so equal addresses are matched once, then to the addresses a target
    meets in each part (by their newest application), and last to the applications of those addresses.
    """
    cleaned, addressed = _addresses(targets, applications)
    newest = [F.col("created_at").desc(), F.col("application_id").desc()]
    shortlist = top_per_key(addressed, ["candidate"], newest, limit + 1)
    pairs = containing_pairs(cleaned, _newest_per_address(shortlist))
    pairs = top_per_key(pairs, ["target"], [F.col("newest_at").desc(), F.col("newest_id").desc()], limit + 1)
    pairs = pairs.select("target", "candidate")
    per_target = top_per_key(pairs.join(shortlist.drop("rank"), "candidate"), ["target"], newest, limit + 1).drop("rank")
    best = _best_others(cleaned, per_target, newest, ["application_id", "candidate"], limit)
    return best.select("target_id", "application_id", "rank", similarity(F.col("target"), F.col("candidate")).alias("similarity"))


def application_postcodes(submissions: DataFrame, fields: DataFrame) -> DataFrame:
    """Distinct (application_id, postcode key) over all submissions; blanks removed, upper case."""
    owners = submissions.select(F.col("id").alias("submission_id"), "application_id")
    codes = fields.where((F.col("field_name") == "postcode") & F.col("field_value").isNotNull())
    keyed = codes.select("submission_id", F.upper(F.regexp_replace("field_value", " ", "")).alias("postcode_key")).distinct()
    return keyed.join(owners, "submission_id").select("application_id", "postcode_key").distinct()


def postcode_matches(targets: DataFrame, postcodes: DataFrame, applications: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Up to ``limit`` newest other applications that share the target's postcode.

    ``targets``: target_id, postcode. Each postcode is reduced to its newest candidates before targets meet it.
    """
    dated = postcodes.join(applications.select(F.col("id").alias("application_id"), "created_at"), "application_id")
    newest = [F.col("created_at").desc(), F.col("application_id").desc()]
    shortlist = top_per_key(dated, ["postcode_key"], newest, limit + 1).drop("rank")
    keyed = targets.where(F.coalesce(F.col("postcode") != "", F.lit(False))).select(
        "target_id", F.upper(F.regexp_replace("postcode", " ", "")).alias("postcode_key")
    )
    others = keyed.join(shortlist, "postcode_key").where(F.col("target_id") != F.col("application_id"))
    return top_per_key(others, ["target_id"], newest, limit).select("target_id", "application_id", "rank")


def potential_parents(targets: DataFrame, by_address: DataFrame, by_postcode: DataFrame) -> DataFrame:
    """Address candidates; postcode candidates only for targets without any."""
    fallback = by_postcode.join(by_address.select("target_id").distinct(), "target_id", "left_anti")
    columns = ["target_id", "application_id", "rank"]
    found = by_address.select(*columns, F.lit("address").alias("via")).unionByName(
        fallback.select(*columns, F.lit("postcode").alias("via"))
    )
    return found.join(targets.select("target_id"), "target_id", "left_semi")


def discover_parents(
    targets: DataFrame, applications: DataFrame, newest_submission: DataFrame, closest: DataFrame, by_postcode: DataFrame
) -> DataFrame:
    """Parent submission, confidence and strategy per target: reference, close address, single postcode match.

    ``closest``: target_id, application_id, similarity of the best address, chosen from all candidates.
    ``targets``: target_id, texts array<string> (searched in order). ``newest_submission``: application_id, submission_id.
    """
    newest = newest_submission.select("application_id", "submission_id")
    reference = targets.select(
        "target_id", F.get(F.filter(F.transform("texts", lambda x: parent_reference(x)), lambda x: x.isNotNull()), 0).alias("ref")
    )
    named = reference.where(F.col("ref").isNotNull()).join(
        applications.select(F.col("application_ref").alias("ref"), F.col("id").alias("application_id")), "ref"
    )
    by_ref = named.join(newest, "application_id").select("target_id", F.col("submission_id").alias("ref_submission"), "ref")
    close = closest.where(F.col("similarity") >= 0.9).join(newest, "application_id")
    close = close.select("target_id", F.col("submission_id").alias("address_submission"), "similarity")
    shared = by_postcode.groupBy("target_id").agg(F.count(F.lit(1)).alias("matches"), F.min("application_id").alias("application_id"))
    shared = shared.join(newest, "application_id", "left").select("target_id", "matches", F.col("submission_id").alias("postcode_submission"))
    joined = (
        targets.select("target_id").join(by_ref, "target_id", "left").join(close, "target_id", "left").join(shared, "target_id", "left")
    )
    single = (F.col("matches") == 1) & F.col("postcode_submission").isNotNull()
    return joined.select(
        "target_id",
        F.coalesce("ref_submission", "address_submission", F.when(single, F.col("postcode_submission"))).alias("parent_submission_id"),
        F.when(F.col("ref_submission").isNotNull(), 0.95)
        .when(F.col("address_submission").isNotNull(), F.col("similarity"))
        .when(single, 0.70)
        .otherwise(0.0)
        .alias("confidence"),
        F.when(F.col("ref_submission").isNotNull(), "reference")
        .when(F.col("address_submission").isNotNull(), "address")
        .when(single, "postcode")
        .when(F.col("matches") > 1, "several_at_postcode")
        .otherwise("none")
        .alias("strategy"),
    )


def link_mode(confidence: Column, given: Column) -> Column:
    """`auto` from 0.85 on, `manual` where an officer named a parent, else null."""
    return F.when(confidence >= 0.85, "auto").when(given.isNotNull(), "manual")


def needs_confirmation(confidence: Column, threshold: float = 0.8) -> Column:
    return confidence < threshold


def _found(words: Sequence[str], text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]), lambda x: x.isNotNull())


def submission_type(description: Column, has_parent: Column, address: Column, parent_address: Column, use: Column, parent_use: Column) -> Column:
    """struct<submission_type, confidence, indicators>: keyword and field comparison, first rule that applies."""
    text, here, there = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(address, F.lit(""))), F.lower(F.coalesce(parent_address, F.lit("")))
    own, other = F.lower(F.coalesce(use, F.lit(""))), F.lower(F.coalesce(parent_use, F.lit("")))

    def outcome(kind: str, confidence: float, indicators: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("submission_type"),
            F.lit(confidence).alias("confidence"),
            F.array_join(indicators, ",").alias("indicators"),
        )

    return (
        F.when(
            ~has_parent & contains_any(text, RESUBMISSION_WORDS), outcome("resubmission", 0.6, _found(RESUBMISSION_WORDS, text))
        )
        .when(~has_parent, outcome("new_construction", 0.6, F.array(F.lit("no_parent"))))
        .when(contains_any(text, MODIFICATION_WORDS), outcome("modification", 0.7, _found(MODIFICATION_WORDS, text)))
        .when((here != "") & (there != "") & (here != there), outcome("new_construction", 0.8, F.array(here, there)))
        .when((own != "") & (other != "") & (own != other), outcome("new_construction", 0.75, F.array(own, other)))
        .otherwise(outcome("modification", 0.5, F.array(F.lit("parent_exists"), F.lit("no_strong_indicators"))))
    )


def v0_backfill(applications: DataFrame, submissions: DataFrame) -> DataFrame:
    """A V0 submission for every application that has none."""
    return applications.join(
        submissions.select(F.col("application_id").alias("id")).distinct(), "id", "left_anti"
    ).select(F.col("id").alias("application_id"), F.lit("V0").alias("submission_version"), F.lit("pending").alias("status"), "created_at")
