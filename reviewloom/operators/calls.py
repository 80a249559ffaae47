"""Model calls with a bounded number in flight: a task waits for many answers at a time."""

from __future__ import annotations

import asyncio
import inspect
import time
from collections import deque
from collections.abc import Awaitable, Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Thread

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import RESPONSE
from .clean import require_columns

Answer = "str | Mapping | None"
#: Builds a client inside a task. A client takes a list of prompts and gives a list of as
#: many answers (text, or a mapping with ``content`` and, if known, ``tokens_used`` and
#: ``cost``). It may be a coroutine function.
ListClientFactory = Callable[[], Callable[[Sequence[str]], "Sequence | Awaitable[Sequence]"]]

#: Rows handed to Spark at once.
ROWS_OUT = 512


def listed(client_factory: Callable[[], Callable]) -> ListClientFactory:
    """A factory of list clients from one whose clients take one prompt."""

    def build():
        client = client_factory()
        if inspect.iscoroutinefunction(client):

            async def each(prompts):
                return await asyncio.gather(*[client(prompt) for prompt in prompts])

            return each
        return lambda prompts: [client(prompt) for prompt in prompts]

    return build


class Window:
    """Calls in flight, at most ``size`` of them; results come in the order of the calls."""

    def __init__(self, client: Callable, size: int):
        self.client, self.size = client, size
        self.pending: deque[tuple[object, Future]] = deque()
        self.loop = self.pool = None
        if inspect.iscoroutinefunction(client):
            self.loop = asyncio.new_event_loop()
            self.thread = Thread(target=self.loop.run_forever, daemon=True)
            self.thread.start()
        else:
            self.pool = ThreadPoolExecutor(size)

    def _timed(self, prompts: list[str]) -> tuple[list, float]:
        started = time.perf_counter()
        answers = list(self.client(prompts))
        return _checked(answers, prompts), time.perf_counter() - started

    async def _timed_async(self, prompts: list[str]) -> tuple[list, float]:
        started = time.perf_counter()
        answers = list(await self.client(prompts))
        return _checked(answers, prompts), time.perf_counter() - started

    def start(self, prompts: list[str]) -> Future:
        if self.loop is not None:
            return asyncio.run_coroutine_threadsafe(self._timed_async(prompts), self.loop)
        return self.pool.submit(self._timed, prompts)

    def add(self, ticket, prompts: list[str]) -> Iterator[tuple[object, Future]]:
        """Start a call; first gives finished ones, oldest first, until there is room."""
        while len(self.pending) >= self.size:
            yield self._oldest()
        self.pending.append((ticket, self.start(prompts)))

    def drain(self) -> Iterator[tuple[object, Future]]:
        while self.pending:
            yield self._oldest()

    def _oldest(self) -> tuple[object, Future]:
        ticket, future = self.pending.popleft()
        future.exception()  # waits
        return ticket, future

    def close(self) -> None:
        for _, future in self.pending:
            future.cancel()
        if self.pool is not None:
            self.pool.shutdown(wait=False, cancel_futures=True)
        if self.loop is not None:
            self.loop.call_soon_threadsafe(self.loop.stop)
            self.thread.join()
            self.loop.close()


def _checked(answers: list, prompts: list[str]) -> list:
    if len(answers) != len(prompts):
        raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
    return answers


def infer_batched(
    prompts: DataFrame,
    client_factory: ListClientFactory,
    model: str,
    provider: str,
    prompt: str = "prompt",
    keep: tuple[str, ...] = ("prompt_hash",),
    batch_size: int = 1,
    in_flight: int = 8,
    isolate: bool = True,
) -> DataFrame:
    """One response per row and ``error``, beside the ``keep`` columns.

    A call has up to ``batch_size`` prompts, and a task has up to ``in_flight`` calls in
    flight, in threads or, for a coroutine, in one event loop. Rows leave in the order they
    came in. A null prompt is not sent. When a call of several prompts fails, each is asked
    alone; one that fails then has its error in place of an answer, and the others theirs.
    With ``isolate`` off a failure fails the task, which Spark retries. Seconds of a call
    are shared out evenly. Lazy: every action on the result calls the model again.
    """
    require_columns(prompts, prompt, *keep)
    if batch_size < 1 or in_flight < 1:
        raise ValueError("batch_size and in_flight must be 1 or more")
    sent = prompts.select(*keep, prompt)
    added = [*RESPONSE.fields, StructField("error", StringType(), True)]
    schema = StructType([*[sent.schema[name] for name in keep], *added])
    names = [field.name for field in added]

    def call_model(batches):
        import pandas as pd

        window = Window(client_factory(), in_flight)

        def row(answer, seconds, error=None):
            if answer is None or isinstance(answer, str):
                answer = {"content": answer}
            tokens, cost = answer.get("tokens_used"), answer.get("cost")
            return (answer["content"], model, provider, tokens, seconds, cost, error)

        def answered(texts: list[str], future: Future) -> list[tuple]:
            error = future.exception()
            if error is None:
                answers, seconds = future.result()
                return [row(answer, seconds / len(texts)) for answer in answers]
            if not isolate:
                raise error
            if len(texts) == 1:
                return [row(None, None, f"{type(error).__name__}: {error}")]
            # one at a time: the window's other calls go on, so no more than its size
            return [answered([text], window.start([text]))[0] for text in texts]

        def frame(done: list[tuple]):
            kept = pd.concat([part for part, _ in done], ignore_index=True)
            out = pd.DataFrame([r for _, rows in done for r in rows], columns=names)
            out["tokens_used"] = out["tokens_used"].astype("Int32")
            for name in ("cost", "response_time"):
                out[name] = out[name].astype("Float64")
            return pd.concat([kept, out], axis=1)

        def finished(part, future):
            rows = iter(answered([t for t in part[prompt] if t is not None], future))
            silent = row(None, None)
            return part[list(keep)], [silent if t is None else next(rows) for t in part[prompt]]

        done, held = [], 0
        try:
            for batch in batches:
                for start in range(0, len(batch), batch_size):
                    part = batch.iloc[start : start + batch_size]
                    texts = [t for t in part[prompt] if t is not None]
                    for ticket in window.add(part, texts) if texts else _nothing(window, part):
                        done.append(finished(*ticket))
                        held += len(ticket[0])
                    if held >= ROWS_OUT:
                        yield frame(done)
                        done, held = [], 0
            for ticket in window.drain():
                done.append(finished(*ticket))
            if done:
                yield frame(done)
        finally:
            window.close()

    return sent.mapInPandas(call_model, schema)


def _nothing(window: Window, part) -> Iterator[tuple[object, Future]]:
    """A part without prompts keeps its place among the calls, but is none."""
    empty: Future = Future()
    empty.set_result(([], 0.0))
    while len(window.pending) >= window.size:
        yield window._oldest()
    window.pending.append((part, empty))
