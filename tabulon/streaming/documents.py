"""Line records to documents as a stream: what `line_groups` makes of finished files, made while they arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "next long, doc long, open array<string>, early string, latest long"


def documents_stream(lines: DataFrame, late: str = "10 minutes", quiet_ms: int = 600_000, separator: str = "") -> DataFrame:
    """(file, doc, text) of lines (file, line from 0, text, ts): a record of a lone line end (or blank) closes a document.

    The state of a file is its open document, the number of the line that comes next, and lines that came before their
    turn; lines may come in any order and twice. A file whose newest line lies `quiet_ms` behind the watermark
    is taken to be over: its open document is given out, with early lines in order, and its state goes.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upcoming, doc, opened, early, latest = state.get if state.exists else (0, 0, [], "{}", 0)
        opened, waiting, out = list(opened), {int(k): v for k, v in json.loads(early).items()}, []

        def take(text: str | None) -> None:
            nonlocal doc, opened
            if (text or "").strip(" \t\n\v\f\r"):
                opened.append(text)
                return
            if opened:
                out.append((key[0], doc, separator.join(opened)))
            doc, opened = doc + 1, []

        if state.hasTimedOut:
            for line in sorted(waiting):
                take(waiting[line])
            if opened:
                out.append((key[0], doc, separator.join(opened)))
            state.remove()
        else:
            for b in batches:
                waiting |= {int(n): t for n, t in zip(b["line"], b["text"], strict=True) if n >= upcoming}
                latest = max(latest, int(b["ts"].max().timestamp() * 1000))
            while upcoming in waiting:
                take(waiting.pop(upcoming))
                upcoming += 1
            state.update((upcoming, doc, opened, json.dumps(waiting), latest))
            state.setTimeoutTimestamp(max(latest + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["file", "doc", "text"])

    kept = lines.select("file", "line", "text", "ts").withWatermark("ts", late)
    return kept.groupBy("file").applyInPandasWithState(fold, "file string, doc long, text string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
