"""Marking by request: which submission is to be marked against which key, stored or given with the request.

`requests` holds request_id, submission_id, key_id (of a stored key, or null), answer_key and drawing_key (maps of question to
answer, or null). Any number of requests is marked in one job: their keys become rows of one key table beside the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.operators import listing, marking
from markspan.session import written

# Why a request is not carried out.
NO_SUBMISSION = "Submission not found"
NOT_COMPLETED = "Submission not yet completed"
NO_KEY = "Answer key not found"
NO_KEY_GIVEN = "Provide answer_key_id or answer_key"
NO_CANDIDATES = "No candidate results found for this submission"


def _stored() -> Column:
    return F.coalesce(F.col("key_id") != 0, F.lit(False))


def checked_requests(requests: DataFrame, submissions: DataFrame, keys: DataFrame, sheets: DataFrame) -> DataFrame:
    """Requests with ready and reason. A key id other than 0 goes before a key given with the request."""
    status = submissions.select("submission_id", listing.completed().alias("__done"))
    known = keys.select(F.col("key_id").alias("__key")).distinct().withColumn("__known", F.lit(True))
    some = sheets.select("submission_id").distinct().withColumn("__some", F.lit(True))
    told = requests.join(status, "submission_id", "left").join(known, F.col("key_id") == F.col("__key"), "left").join(some, "submission_id", "left")
    given = F.coalesce(F.size("answer_key") > 0, F.lit(False))
    reason = (
        F.when(F.col("__done").isNull(), NO_SUBMISSION)
        .when(~F.col("__done"), NOT_COMPLETED)
        .when(_stored() & F.col("__known").isNull(), NO_KEY)
        .when(~_stored() & ~given, NO_KEY_GIVEN)
        .when(F.col("__some").isNull(), NO_CANDIDATES)
    )
    return told.select(*requests.columns, reason.isNull().alias("ready"), reason.alias("reason"))


def requested_keys(ready: DataFrame, key_long: DataFrame, drawing_long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all keys that the requests name: stored ones under `stored:<id>`, given ones under `given:<request>`."""
    wanted = ready.filter(_stored()).select("key_id").distinct()

    def rows(stored: DataFrame, given: str, value: str) -> DataFrame:
        named = stored.join(wanted, "key_id", "left_semi").select(_name("stored", "key_id"), F.col("question").cast("string").alias("question"), value)
        own = ready.filter(~_stored()).select(_name("given", "request_id"), F.explode(given).alias("question", value))
        return named.unionByName(own)

    return rows(key_long, "answer_key", "correct"), rows(drawing_long, "drawing_key", "expected")


def _name(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string")).alias("key_id")


def marked_by_request(
    requests: DataFrame, submissions: DataFrame, sheets: DataFrame, key_long: DataFrame, drawing_long: DataFrame, answers: DataFrame, responses: DataFrame
) -> DataFrame:
    """Every candidate of each request that is ready: request_id, the sheet's columns, key_id, marked_answers, marked_drawing,
    correct, total, percentage. A stored key brings its own drawing key, a given one that of the request."""
    ready = written(checked_requests(requests, submissions, key_long, sheets).filter("ready"), "ready-requests")
    keys, drawing = requested_keys(ready, key_long, drawing_long)
    name = F.when(_stored(), _name("stored", "key_id")).otherwise(_name("given", "request_id")).alias("key_id")
    asked = sheets.join(ready.select("request_id", "submission_id", name), "submission_id")

    def as_text(df: DataFrame) -> DataFrame:
        return df.withColumn("question", F.col("question").cast("string"))

    return marking.marked_sheets(asked, keys, as_text(answers), drawing, as_text(responses))
