"""User-supplied page functions run over partitions, with retries and error rows."""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.operators.layout import representative_pages
from markspan.operators.normalize import parse_format_responses

PageFunction = Callable[[dict], str]
# Fixed value: seconds to wait after the first and the second failure.
WAITS = (2.0, 4.0)

# Fixed value: wording of the questions a prompt asks, by type.
ASK = {
    "mcq": "Questions {r} are multiple choice with options {o}. Give the printed letter of the marked option, BL if none, IN if several.",
    "numeric": "Questions {r} are written answers. Copy what is written, BL if empty.",
    "drawing": "Questions {r} are drawings. Give DR for a drawing, the text if it is text, BL if empty.",
}


def call_pages(
    pages: DataFrame,
    fn: PageFunction,
    id_col: str = "page",
    attempts: int = 3,
    waits: Sequence[float] = WAITS,
    concurrency: int | None = None,
    in_flight: int = 1,
) -> DataFrame:
    """Call `fn(row)` once per page; rows are (id, response, attempts, error), in the order in which the calls end.

    A page that fails on every attempt gives an error row and never fails the job. A task may run again after a lost
    executor, so `fn` must be safe to repeat; rows are keyed by page. `concurrency` is the number of tasks, `in_flight` that of calls a
    task has running at a time, from threads of its own; with more than one `fn` must allow that. A page that waits for its next
    attempt holds no call back."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.to_dict("records"))
        done: list[tuple] = []
        for result in _calls(rows, fn, attempts, waits, in_flight):
            done.append((result[0][id_col], *result[1:]))
            if len(done) == ROWS_OUT:
                yield _frame(done, id_col)
                done = []
        if done:
            yield _frame(done, id_col)

    spread = pages.repartition(concurrency) if concurrency else pages
    id_type = pages.schema[id_col].dataType.simpleString()
    return spread.mapInPandas(run, f"{id_col} {id_type}, response string, attempts int, error string")


ROWS_OUT = 64  # results that a task hands on together
WAITING = 4  # pages, per call in flight, that may wait for their next attempt while new ones are begun


def _frame(done: list[tuple], id_col: str) -> pd.DataFrame:
    return pd.DataFrame(done, columns=[id_col, "response", "attempts", "error"], dtype="object")


def _calls(
    rows: Iterator[dict], fn: PageFunction, attempts: int, waits: Sequence[float], in_flight: int
) -> Iterator[tuple[dict, str | None, int, str | None]]:
    """(row, response, attempts, error) of each row, as the calls end."""
    if in_flight == 1 and not any(waits):
        yield from _direct_calls(rows, fn, attempts)
        return
    running: dict[Future, tuple[dict, int]] = {}
    waiting: list[tuple[float, int, dict, int]] = []  # when due, a number for order, the row, the next attempt
    numbers = count()
    more = True
    with ThreadPoolExecutor(in_flight) as pool:
        while more or running or waiting:
            now = time.monotonic()
            while len(running) < in_flight:
                if waiting and waiting[0][0] <= now:
                    _, _, row, attempt = heapq.heappop(waiting)
                elif more and len(waiting) < WAITING * in_flight:
                    row, attempt = next(rows, None), 1
                    if row is None:
                        more = False
                        continue
                else:
                    break
                running[pool.submit(fn, row)] = row, attempt
            pause = max(0.0, waiting[0][0] - now) if waiting else None
            if not running:
                time.sleep(pause or 0.0)
                continue
            # With all calls running, a page that becomes due has to wait for one of them anyway.
            ended, _ = wait(running, timeout=pause if len(running) < in_flight else None, return_when=FIRST_COMPLETED)
            for future in ended:
                row, attempt = running.pop(future)
                error = future.exception()
                if error is None:
                    yield row, future.result(), attempt, None
                elif not isinstance(error, Exception):
                    raise error
                elif attempt == attempts:
                    yield row, None, attempt, str(error)
                else:
                    due = time.monotonic() + (waits[min(attempt, len(waits)) - 1] if waits else 0.0)
                    heapq.heappush(waiting, (due, next(numbers), row, attempt + 1))


def _direct_calls(rows: Iterator[dict], fn: PageFunction, attempts: int) -> Iterator[tuple[dict, str | None, int, str | None]]:
    """The same where one call runs at a time and none waits: without a thread, whose hand-over takes longer than a short call."""
    for row in rows:
        for attempt in range(1, attempts + 1):
            try:
                response = fn(row)
            except Exception as error:
                if attempt == attempts:
                    yield row, None, attempt, str(error)
            else:
                yield row, response, attempt, None
                break


def detect_formats(pages: DataFrame, fn: PageFunction, attempts: int = 1) -> DataFrame:
    """One format per layout, from one call on the layout's best page; failures give the fallback format."""
    return formats_of(representative_pages(pages), fn, attempts)


def formats_of(chosen: DataFrame, fn: PageFunction, attempts: int = 1) -> DataFrame:
    """The formats of already chosen pages, one row (layout_hash, page) per layout."""
    asked = chosen.withColumnRenamed("layout_hash", "format_id")
    return parse_format_responses(call_pages(asked, fn, id_col="format_id", attempts=attempts, waits=()))


def page_prompt(formats: DataFrame) -> DataFrame:
    """The request text of each format row: header labels, then the questions by type."""
    labels = F.array_join(F.transform("header_fields", lambda h: F.concat(F.lit("- "), h["label"])), "\n")
    options = F.array_join("answer_options", ", ")

    def section(q_type: str) -> Column:
        span = F.concat_ws("-", f"{q_type}_start", f"{q_type}_end")
        text = F.replace(F.replace(F.lit(ASK[q_type]), F.lit("{r}"), span), F.lit("{o}"), options)
        return F.when(F.col(f"{q_type}_start").isNotNull(), text)

    keys = F.array_join(F.transform("header_fields", lambda h: h["key"]), ", ")
    closing = F.concat(F.lit("Return one JSON object with the keys "), keys, F.lit(" and answers."))
    text = F.concat_ws("\n", F.lit("Header fields:"), labels, section("mcq"), section("numeric"), section("drawing"), closing)
    return formats.withColumn("prompt", text)
