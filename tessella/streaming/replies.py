"""A stream of reply deltas split into thinking and answer, with state by request."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.assist import THINK_CLOSE, THINK_OPEN, THINK_PREFIXES

#: A rule's way to say that more text must come first.
WAIT = None


def _begin(text: str, last: bool):
    """A reply's beginning: thinking, an answer, or (in a prefix's letters but for their case) thinking if a closing mark comes."""
    start = text.lstrip()
    if THINK_CLOSE in text or start.startswith(THINK_PREFIXES):
        return "think", "", text.replace(THINK_OPEN, "", 1) if start.startswith(THINK_OPEN) else text
    low = start.lower()
    if not last and any(p.lower().startswith(low) for p in THINK_PREFIXES):
        return WAIT
    return ("unsure" if low.startswith(tuple(p.lower() for p in THINK_PREFIXES)) else "answer"), "", text


def _unsure(text: str, last: bool):
    return ("think", "", text) if THINK_CLOSE in text else ("answer", "", text) if last else WAIT


def _think(text: str, last: bool):
    """All but what may be the beginning of the closing mark."""
    before, mark, after = text.partition(THINK_CLOSE)
    if mark:
        return "answer", before, after
    sure = len(text) if last else len(text) - len(THINK_CLOSE) + 1
    return ("think", text[:sure], text[sure:]) if sure > 0 else WAIT


def _answer(text: str, last: bool):
    return ("answer", text, "") if text else WAIT


#: State: what it makes of the text that is held: the next state, text to give out as the state's own, text to hold.
RULES = {"": _begin, "unsure": _unsure, "think": _think, "answer": _answer}


class Splitter:
    """An automaton that feeds on deltas and yields ``(kind, text)``; ``mode`` (empty at first) and ``held`` are its whole state."""

    def __init__(self, mode: str = "", held: str = ""):
        self.mode, self.held = mode, held

    def feed(self, delta: str, last: bool = False) -> Iterator[tuple[str, str]]:
        self.held += delta
        while self.held and (step := RULES[self.mode](self.held, last)) is not WAIT:
            kind, (self.mode, out, self.held) = self.mode, step
            if out:
                yield kind, out

    def finish(self) -> Iterator[tuple[str, str]]:
        yield from self.feed("", True)


def split_stream(deltas: DataFrame) -> DataFrame:
    """``request_id, kind, text`` of a stream ``request_id, seq, delta, last`` (boolean: the request's last delta).

    ``seq`` counts a request's deltas from 0. Those that come before their turn wait in the state, whatever batch or frame brings them.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, held, turn, waiting = state.get if state.exists else ("", "", 0, "{}")
        splitter, waiting = Splitter(mode, held), json.loads(waiting)
        for frame in frames:
            waiting |= {str(seq): (delta or "", bool(last)) for seq, delta, last in frame[["seq", "delta", "last"]].itertuples(index=False)}
        out: list[tuple] = []
        ended = False
        while not ended and str(turn) in waiting:
            delta, ended = waiting.pop(str(turn))
            out += splitter.feed(delta, ended)
            turn += 1
        if not ended:
            state.update((splitter.mode, splitter.held, turn, json.dumps(waiting)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], k, t) for k, t in out], columns=["request_id", "kind", "text"])

    kind = deltas.schema["request_id"].dataType.simpleString()
    return deltas.groupBy("request_id").applyInPandasWithState(step, f"request_id {kind}, kind string, text string", "mode string, held string, turn long, waiting string", "append", GroupStateTimeout.NoTimeout)


def sse_data(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``data``: payloads of server-sent events; comments and the end mark are left out."""
    data = F.regexp_extract(value_col, r"^data:\s?(.*)$", 1)
    return lines.filter(F.col(value_col).startswith("data:")).select(data.alias("data")).filter("data <> '[DONE]'")
