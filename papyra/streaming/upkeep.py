"""Streams: incremental index upkeep, debounced exports, embedding with retries, in-order parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.operators.index import KeptIndex
from papyra.operators.state import changed_documents, contiguous_prefix


def keep_index(stream: DataFrame, known: Callable[[], DataFrame], index: Callable[[DataFrame], None], checkpoint: str, schema: int, once: bool = False):
    """Index the documents of each micro-batch that changed since the index last saw them."""

    def batch(df: DataFrame, _: int) -> None:
        changed = changed_documents(df, known(), schema)
        if not changed.isEmpty():
            index(changed)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def index_stream(stream: DataFrame, index: KeptIndex, checkpoint: str, once: bool = False):
    """Put the works of each micro-batch (all their chunks: chunk_id, work_id, text) in place of their old ones.

    A batch that runs again after a restart writes its own generation again, so each change counts once.
    """

    def batch(df: DataFrame, number: int) -> None:
        index.update(df, generation=2 * number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def embed_batches(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 20, most_failures: int = 3) -> DataFrame:
    """chunk_id, vector, error: batches of 20; a failed batch is tried item by item.

    After three failed items in a row a task leaves the rest of its rows with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                rows: list[tuple] = []
                try:
                    if failed >= most_failures:
                        raise RuntimeError("too many failures in a row")
                    rows = [(c, v, None) for c, v in zip(part["chunk_id"], embed(list(part["text"])), strict=True)]
                    failed = 0
                except Exception as batch_error:  # noqa: BLE001 - an embedding provider may raise anything
                    for chunk, text in zip(part["chunk_id"], part["text"], strict=True):
                        if failed >= most_failures:
                            rows.append((chunk, None, str(batch_error)))
                            continue
                        try:
                            rows.append((chunk, embed([text])[0], None))
                            failed = 0
                        except Exception as error:  # noqa: BLE001
                            failed += 1
                            rows.append((chunk, None, str(error)))
                yield pd.DataFrame(rows, columns=["chunk_id", "vector", "error"])

    kind = dict(chunks.dtypes)["chunk_id"]
    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {kind}, vector array<float>, error string")


def _in_order(pdfs: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch: a shuffle has no order, so they are put into one."""
    return pd.concat(list(pdfs), ignore_index=True).sort_values(by, kind="stable")


def accept_parts(stream: DataFrame) -> DataFrame:
    """task, part, text of parts that arrive as the next of their task; repeats and gaps are ignored.

    stream has task string, part int, text string.  Parts that arrive together are taken in order of their numbers.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        rows = []
        for part, text in _in_order(pdfs, "part")[["part", "text"]].itertuples(index=False):
            if part == done + 1:
                done += 1
                rows.append((key[0], int(part), text))
        state.update((done,))
        yield pd.DataFrame(rows, columns=["task", "part", "text"])

    return stream.groupBy("task").applyInPandasWithState(step, "task string, part int, text string", "done int", "append", GroupStateTimeout.NoTimeout)


def append_parts(stream: DataFrame, draft: str, checkpoint: str, once: bool = False):
    """Accepted parts, each exactly once, into the table at ``draft``: what is there and what counts as done cannot differ after a restart.

    State and sources are in the checkpoint, and the file sink lists the files of whole micro-batches only, so a batch
    that was cut off is run again and its half-written files are not read.
    """
    writer = accept_parts(stream).writeStream.outputMode("append").format("parquet").option("path", draft).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def repair_progress(progress: DataFrame, parts: DataFrame) -> DataFrame:
    """progress (task, total, completed) after a restart: completed as the draft's parts (task, part) have it, and whether the task can go on.

    A draft without its first part, or with all of them, is none to go on with.
    """
    found = contiguous_prefix(parts, "task", "part").withColumnRenamed("completed", "recovered")
    out = progress.join(found, "task", "left").withColumn("recovered", F.coalesce("recovered", F.lit(0)).cast("int"))
    return out.select("task", "total", F.col("recovered").alias("completed"), (F.col("recovered") != F.col("completed")).alias("repaired"), ((F.col("recovered") > 0) & (F.col("recovered") < F.col("total"))).alias("resumable"))


def debounce(stream: DataFrame, key: str, order: str, quiet_ms: int = 750) -> DataFrame:
    """The last row of each key by ``order``, once no row of the key has come for ``quiet_ms``: a burst gives one row.

    Each row puts a timer of its key off, so the time counts from the last change; only that row is state.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.to_json(F.struct("*")).alias("row"))

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            row = state.get[1]
            state.remove()
            yield pd.DataFrame({"row": [row]})
            return
        last = _in_order(pdfs, "at").iloc[-1]
        if not state.exists or last["at"] >= state.get[0]:
            state.update((int(last["at"]), last["row"]))
        else:
            state.update(state.get)
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"row": []}, dtype=object)

    last = rows.groupBy("key").applyInPandasWithState(step, "row string", "at long, row string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return last.select(F.from_json("row", stream.schema).alias("r")).select("r.*")


#: Seconds before each further attempt, after the last of which an item is given up.
RETRIES = {"linear": (0.5, 1.0), "doubling": (1.0, 2.0), "fixed": (2.0, 5.0, 12.0)}


def retry_delay(attempt: Column, policy: str) -> Column:
    """Seconds to wait after the attempt-th failure (from 1); null when the item is given up."""
    return F.get(F.array(*[F.lit(s) for s in RETRIES[policy]]), attempt - 1)


def retry_schedule(failures: DataFrame, policy: str, by: str = "item", at: str = "at") -> DataFrame:
    """failures (item, at) with attempt, due (the time of the next try) and given_up, each item's in order of time."""
    attempt = F.row_number().over(Window.partitionBy(by).orderBy(at))
    out = failures.withColumn("attempt", attempt).withColumn("_delay", retry_delay(F.col("attempt"), policy))
    due = F.timestamp_millis(F.unix_millis(F.col(at).cast("timestamp")) + (F.col("_delay") * 1000).cast("long"))
    return out.withColumn("due", due.cast(dict(failures.dtypes)[at])).withColumn("given_up", F.col("_delay").isNull()).drop("_delay")


def due_retries(outcomes: DataFrame, policy: str, unit_ms: int = 1000) -> DataFrame:
    """item, attempt, given_up: items to try again, when their wait is over, from a stream of outcomes (item string, ok boolean).

    A failure sets its item's timer to the policy's wait; a success, or giving up after the last wait, forgets the item.
    unit_ms is what a second of the policy takes.
    """
    waits = RETRIES[policy]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        if state.hasTimedOut:
            failed = state.get[0]
            state.update((failed,))  # the next outcome goes on counting
            rows.append((key[0], failed + 1, False))
        else:
            failed = state.get[0] if state.exists else 0
            ok = pd.concat(list(pdfs))["ok"]
            if ok.any():
                if state.exists:
                    state.remove()
            elif failed + len(ok) > len(waits):
                rows.append((key[0], failed + len(ok), True))
                if state.exists:
                    state.remove()
            else:
                failed += len(ok)
                state.update((failed,))
                state.setTimeoutDuration(max(1, int(waits[failed - 1] * unit_ms)))
        yield pd.DataFrame(rows, columns=["item", "attempt", "given_up"]).astype({"attempt": "int32", "given_up": "bool"})

    return outcomes.groupBy("item").applyInPandasWithState(step, "item string, attempt int, given_up boolean", "failed int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def server_events(lines: DataFrame) -> DataFrame:
    """event, data of lines (pos, line) of an event stream: data lines up to a blank one are an event.

    For one response, whose lines one task orders.
    """
    order = Window.partitionBy("response").orderBy("pos")
    marked = lines.withColumn("event", F.coalesce(F.sum((F.trim("line") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    data = marked.where(F.col("line").startswith("data:")).withColumn("d", F.trim(F.substring("line", 6, 1 << 20)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]), "\n")
    return data.groupBy("response", "event").agg(joined.alias("data")).where("data <> '[DONE]'")
