"""Token streams: ordered joining, sanitising, the reasoning channel, event frames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verseframe.functions import fixed as K, text as T

#: Characters after which a stream without any tag counts as plain answer.
PLAIN_AFTER = 32


def joined_stream(tokens: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """key, raw: the chunks of a request in order. One request's chunks bound a group."""
    return tokens.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(token), F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("raw"))


def sanitised(tokens: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """key, response: at most one chunk per request, without reasoning; requests of which nothing is left give no row."""
    return joined_stream(tokens, key, order, token).select(key, T.sanitize_output("raw").alias("response")).where("response <> ''")


class Channel:
    """Splits a stream into thinking and response, chunk by chunk; tags may span chunks.

    Until a tag or PLAIN_AFTER characters without the start of one have come, the phase is undecided. A close tag
    without an open one begins the response as well. State is four short values, so that it can be stored between
    batches.
    """

    def __init__(self, phase: int = 0, held: str = "", thinking: str = "", response: str = "") -> None:
        self.phase, self.held, self.thinking, self.response = phase, held, thinking, response

    @staticmethod
    def _after(text: str, tags: tuple[str, ...]) -> tuple[str, str] | None:
        """(text before the tag, text after it) for the first listed tag in the text."""
        for tag in tags:
            before, found, after = text.partition(tag)
            if found:
                return before, after
        return None

    def feed(self, chunk: str) -> None:
        if self.phase == 2:
            self.response += chunk
            return
        self.held += chunk
        if self.phase == 0:
            opened = self._after(self.held, K.OPEN_TAGS)
            if opened:
                self.phase, self.held = 1, opened[1].removeprefix("thought").removeprefix("\n") if opened[1].startswith("thought") else opened[1]
        closed = self._after(self.held, K.CLOSE_TAGS)
        if closed:
            self.thinking += closed[0] if self.phase == 1 else ""
            self.phase, self.held, self.response = 2, "", closed[1]
        elif self.phase == 0 and len(self.held) > PLAIN_AFTER and not any(tag[:4] in self.held for tag in K.OPEN_TAGS + K.CLOSE_TAGS):
            self.phase, self.response, self.held = 2, self.held, ""

    def finish(self) -> tuple[str, str]:
        """(thinking, response) when the stream has ended: what is held belongs to the open phase."""
        if self.held and self.phase == 1:
            self.thinking += self.held
        elif self.held:
            self.response += self.held
        self.phase, self.held = 2, ""
        return self.thinking, self.response


_SCHEMA = "thinking string, response string"
_STATE = "phase int, held string, thinking string, response string"


def channels(tokens: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """key, thinking, response of finished requests, in batch; markup is stripped from the response."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, chunks in zip(b[key], b["chunks"]):
                c = Channel()
                for chunk in chunks:
                    c.feed(chunk["t"])
                out.append((k, *c.finish()))
            yield pd.DataFrame(out, columns=[key, "thinking", "response"])

    grouped = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(token), F.lit("")).alias("t")))).alias("chunks"))
    got = grouped.mapInPandas(run, f"{key} {kind}, {_SCHEMA}")
    return got.select(key, T.format_thinking("thinking").alias("thinking"), T.strip(T.strip_markdown(T.strip_token_noise("response"))).alias("response"))


def channel_stream(tokens: DataFrame, key: str, order: str, token: str, done: str) -> DataFrame:
    """The same on a stream, with state per request; a row with done = true ends its request and emits it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = tokens.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Channel(*state.get) if state.exists else Channel()
        rows = pd.concat(list(batches)).sort_values(order)
        for chunk in rows[token].fillna(""):
            c.feed(chunk)
        if rows[done].any():
            state.remove() if state.exists else None
            yield pd.DataFrame([(k[0], *c.finish())], columns=[key, "thinking", "response"])
        else:
            state.update((c.phase, c.held, c.thinking, c.response))

    return tokens.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {_SCHEMA}", _STATE, "append", GroupStateTimeout.NoTimeout)


class FrameWriter:
    """Turns the tokens of one request into server-sent frames.

    With flush="space" tokens are held until a blank or line end, or over LONG characters, have come. A stop token, an
    error or `end` closes the request: what is held is sent, then an error frame (also where nothing was said), then the
    frame that ends it; whatever comes later is ignored.
    """

    LONG = 100

    def __init__(self, stop: tuple[str, ...] = (), flush: str = "token", held: str = "", said: bool = False, closed: bool = False) -> None:
        self.stop, self.flush, self.held, self.said, self.closed = frozenset(stop), flush, held, said, closed

    @staticmethod
    def frame(**body: object) -> str:
        return f"data: {json.dumps(body, ensure_ascii=False)}\n\n"

    def feed(self, token: str | None) -> list[str]:
        if self.closed or not token:
            return []
        if token in self.stop:
            return self.end()
        self.held += token
        if self.flush == "space" and not (self.held[-1:].isspace() or len(self.held) > self.LONG):
            return []
        return self._send()

    def _send(self) -> list[str]:
        out = [self.frame(token=self.held)] if self.held else []
        self.said, self.held = self.said or bool(self.held), ""
        return out

    def end(self, error: str | None = None) -> list[str]:
        if self.closed:
            return []
        out = self._send()
        if error is None and not self.said:
            error = "empty generation"
        self.closed = True
        return out + ([self.frame(error=error)] if error else []) + [self.frame(done=True)]


def frame_stream(tokens: DataFrame, key: str, order: str, token: str, kind: str, stop: tuple[str, ...] = (), flush: str = "token", silence_seconds: float | None = None) -> DataFrame:
    """key, frame of a stream of rows (key, order, token, kind): kind is "token", "error" (the token is its message) or
    "done". State per request is what is held, and two marks. A request that is silent for silence_seconds (by the clock)
    is closed with an error; without it a request stays open until its row of kind "done" or "error"."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    name = tokens.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout if silence_seconds is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = FrameWriter(stop, flush, *state.get) if state.exists else FrameWriter(stop, flush)
        out: list[str] = []
        if state.hasTimedOut:
            out = w.end("timeout")
        else:
            rows = pd.concat(list(batches)).sort_values(order)
            for what, text in zip(rows[kind], rows[token]):
                out += w.end(text or "error") if what == "error" else w.end() if what == "done" else w.feed(text)
        if state.hasTimedOut or rows[kind].isin(["done", "error"]).any():
            if state.exists:
                state.remove()
        else:
            state.update((w.held, w.said, w.closed))
            if silence_seconds is not None:
                state.setTimeoutDuration(int(silence_seconds * 1000))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "frame": out})

    return tokens.groupBy(key).applyInPandasWithState(step, f"{key} {name}, frame string", "held string, said boolean, closed boolean", "append", timeout)


def event_frames(tokens: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """key, frame_no, frame: server-sent frames: one per token, an error frame for an empty generation, a final frame."""
    frame = lambda body: F.concat(F.lit("data: "), body, F.lit("\n\n"))
    per = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col(token) != "", F.struct(order, F.col(token).alias("t"))))).alias("c"))
    said = F.transform("c", lambda x: frame(F.to_json(F.struct(x["t"].alias("token")))))
    error = F.array(frame(F.lit('{"error":"empty generation"}')))
    frames = F.concat(F.when(F.size("c") > 0, said).otherwise(error), F.array(frame(F.lit('{"done":true}'))))
    return per.select(key, F.posexplode(frames).alias("frame_no", "frame"))
