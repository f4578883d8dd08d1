"""Results of several files brought together: one review for each person, kept up to date as files come in.

A stored result has person, file, row (its number in the file), collected, code, issues and confidence as its own file
gave them; further columns travel along. What depends on other files (duplicates, decisions) is derived, and derived anew
only for the draws that a new file touches, so that merging again, or a file once more, changes nothing.

Defined cases: a file that comes again replaces all its rows; rows that repeat person, file and row count once (the
smallest); rows without a code are no duplicates; rows without a time are a draw of their own; rows without a person or a
file belong to a person or file of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.operators import review, rows

FILE, DRAW = ("person", "file"), ("person", "collected")
# The span of dates, the most cards at once.
EARLIEST = "1990-01-01"
MOST_CARDS = 12


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """``a`` joined to the distinct keys of ``b``, null keys equal."""
    other = b.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(other, on, how)


def _once(results: DataFrame) -> DataFrame:
    """One row of each person, file and number."""
    rest = [c for c in results.columns if c not in (*FILE, "row")]
    return results.groupBy(*FILE, "row").agg(F.min(F.struct(*rest)).alias("_r")).select(*FILE, "row", "_r.*").select(*results.columns)


def replace_files(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored results after the files of ``incoming`` have come in."""
    return _same(stored, incoming, FILE, "left_anti").unionByName(_once(incoming))


def block_reason(code: Column, issues: Column, printed_unit: Column, has_value: Column) -> Column:
    """Why a result can't be used, the first reason that applies; null if it can."""
    has = lambda name: F.array_contains(issues, name)
    unit = F.when(printed_unit.isNotNull(), F.concat(F.lit("The unit "), printed_unit, F.lit(" can't be used for this test."))).otherwise(F.lit("This result has no unit, and this test needs one."))
    return F.coalesce(
        review.first_reason((code.isNull(), "We couldn't identify this test."), (has("ambiguous_match"), "This name matches more than one test.")),
        F.when(has("unit_mismatch"), unit),
        review.first_reason((~has_value, "We couldn't read this result."), (has("implausible"), "This value is outside the possible range for this test, so it was probably misread.")),
    )


def reviewed(results: DataFrame, reason: Column | None = None) -> DataFrame:
    """``results`` with issues and confidence as all files of a draw together give them, copies, and the decision that holds
    until a reviewer decides: results that are blocked, or have a ``reason``, are excluded and locked."""
    same_test = Window.partitionBy(*DRAW, "code")
    copies = F.when(F.col("code").isNotNull(), F.count("*").over(same_test)).otherwise(F.lit(1).cast("long"))
    twice = (F.col("copies") > 1) & ~F.array_contains("issues", "duplicate")
    blocked = F.arrays_overlap("issues", F.array(*map(F.lit, rows.BLOCKING)))
    told = F.lit(None).cast("string") if reason is None else reason
    return (
        results.withColumn("copies", copies)
        .withColumns({"issues": F.when(twice, F.concat("issues", F.array(F.lit("duplicate")))).otherwise(F.col("issues")), "confidence": F.when(twice, F.lit("low")).otherwise(F.col("confidence"))})
        .withColumns({"locked": blocked | told.isNotNull(), "reason": F.coalesce(told, F.when(blocked, F.lit("This result can't be signed.")))})
        .withColumn("decision", review.decision(F.col("locked"), F.col("confidence"), F.lit(None).cast("string")))
    )


def merge(stored: DataFrame, view: DataFrame, incoming: DataFrame, reason: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored, view) after the files of ``incoming``: ``view`` is ``reviewed(stored)``, of which only the draws that lose
    or gain rows are worked out again."""
    # of all rows, one shuffle by files and one by draws: joins with the touched keys would each take stored rows along again
    own = stored.columns
    both = stored.withColumn("_new", F.lit(False)).unionByName(_once(incoming).withColumn("_new", F.lit(True)))
    flagged = both.withColumn("_gone", ~F.col("_new") & F.max("_new").over(Window.partitionBy(*FILE)))
    changes = F.col("_new") | F.col("_gone")
    kept = _same(view, flagged.where(changes), DRAW, "left_anti")
    again = flagged.withColumn("_touched", F.max(changes).over(Window.partitionBy(*DRAW))).where("_touched and not _gone")
    return flagged.where("not _gone").select(*own), kept.unionByName(reviewed(again.select(*own), reason))


def draws(view: DataFrame) -> DataFrame:
    """person, collected, draw (its number by time), files (those that bring results to it), results, included, pending."""
    decided = lambda d: F.count_if(F.col("decision") == d).alias(d)
    summed = view.groupBy(*DRAW).agg(F.array_sort(F.collect_set("file")).alias("files"), F.count("*").alias("results"), decided("included"), decided("pending"))
    return summed.withColumn("draw", F.row_number().over(Window.partitionBy("person").orderBy(F.col("collected").asc_nulls_last())))


def problems(view: DataFrame, now: Column, patient_problem: DataFrame | None = None) -> DataFrame:
    """person and problems: why no card can be made of a person's results yet, in the order of a review. ``patient_problem``:
    person and problem. Codes are named by ``text``."""
    included, pending = F.col("decision") == "included", F.col("decision") == "pending"
    by_code = view.groupBy(*DRAW, "code", "text").agg(F.count_if(included).alias("n"), F.count_if(pending).alias("pending"))
    repeated = F.when((F.col("n") > 1) & F.col("code").isNotNull(), F.col("text"))
    by_draw = by_code.groupBy(*DRAW).agg(F.sum("n").alias("n"), F.sum("pending").alias("pending"), F.min(repeated).alias("repeated"))
    wrong = F.coalesce((F.col("collected") > now) | (F.col("collected") < F.lit(EARLIEST).cast("timestamp_ntz")), F.lit(True))
    told = F.array_compact(F.array(F.when(wrong, F.lit("A collection date in this report looks wrong. Leave that collection out.")), F.when(F.col("repeated").isNotNull(), F.concat("repeated", F.lit(" appears twice in one collection. Leave one out.")))))
    each = F.array_sort(F.collect_list(F.when(F.size(told) > 0, F.struct(F.col("collected"), told.alias("told")))))
    person = by_draw.groupBy("person").agg(F.sum("pending").alias("pending"), F.count_if(F.col("n") > 0).alias("cards"), F.flatten(F.transform(each, lambda x: x["told"])).alias("by_draw"))
    if patient_problem is None:
        person = person.withColumn("own", F.lit(None).cast("string"))
    else:
        first = patient_problem.groupBy(F.col("person").alias("_p")).agg(F.min("problem").alias("own"))
        person = person.join(first, F.col("person").eqNullSafe(F.col("_p")), "left")
    one = F.col("pending") == 1
    review_first = F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.when(one, F.lit(" result still needs review.")).otherwise(F.lit(" results still need review."))))
    none = F.when((F.col("cards") == 0) & (F.col("pending") == 0), F.lit("There are no results to add."))
    many = F.when(F.col("cards") > MOST_CARDS, F.lit(f"You can create up to {MOST_CARDS} cards at once. Leave some collections out."))
    return person.select("person", F.array_compact(F.concat(F.array("own", review_first), F.col("by_draw"), F.array(none, many))).alias("problems"))


def observations(view: DataFrame) -> DataFrame:
    """The included results as a card takes them: person, collected, code, display, text, kind and, by kind, value with unit,
    comparator and bounds, or words (a titer without its 1:). ``view`` has value_type, value, words, ucum, comparator, low,
    high, display and text."""
    quantity = F.col("value_type") == "quantity"
    only = lambda c: F.when(quantity, F.col(c)).alias(c)
    words = F.when(F.col("value_type") == "titer", F.regexp_replace("words", "^1:", "")).when(~quantity, F.col("words"))
    unit = F.when(quantity, F.col("ucum")).alias("unit")
    return view.where("decision = 'included'").select(*DRAW, "code", "display", "text", F.col("value_type").alias("kind"), only("value"), unit, only("comparator"), only("low"), only("high"), words.alias("words"))
