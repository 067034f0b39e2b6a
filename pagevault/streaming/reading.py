"""Streams of ticks from reading tabs, with state that is dropped when a tab falls silent.

Both operators keep one row of state a key and one event-time timer, ``idle`` after the
key's latest tick.  When the watermark passes it, the state goes: state is bounded by
the keys that were active within ``idle`` and ``late``, however many were ever seen.

Defined results: ticks are taken in order of time within a micro-batch; a tick older
than one already taken adds no time, but its scroll depth counts; a tick behind the
watermark is dropped; a key that comes back after its state went starts anew.  A
restart from the checkpoint goes on with state and timers.  Timers need the RocksDB
state store, which both functions set in the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagevault import schemas as S

TICK_MS = 3000  # most that one tick adds
OFFER_MS = 5000
LATE, IDLE_MS = "10 minutes", S.HOUR_MS
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Reading:
    """Where a tab stands: the page, its latest tick, time in focus, depth; offers made, the focus that the next one waits for, the depth at the last one, whether it was answered for good."""

    page: str
    last: int
    focused: int = 0
    depth: float = 0.0
    offers: int = 0
    wait: int = 0
    offered_at: float = 0.0
    closed: bool = False

    def after(self, tick: Row) -> Reading:
        """The state once a tick was seen; another page starts anew, a fragment is no other page."""
        page, ms = tick.url.partition("#")[0], _ms(tick)
        if page != self.page:
            return Reading(page, ms)
        gained = min(max(ms - self.last, 0), S.TICK_MS + S.TICK_SLACK_MS) if tick.visible else 0
        depth = max(self.depth, tick.scroll)
        return replace(self, last=max(self.last, ms), focused=self.focused + gained, depth=depth, wait=self.wait if depth - self.offered_at < S.SCROLL_STEP else 0)

    @property
    def due(self) -> bool:
        """Whether the page is to be offered now."""
        return not self.closed and self.focused >= max(self.wait, S.OFFER_FLOOR_MS)

    def offered(self, tick: Row) -> tuple[Reading, str]:
        """The state after an offer, and the answer: the policy's reason, or read, or that it goes on (and is asked less and less often)."""
        enough = tick.pdf or 0 < tick.words <= S.SHORT_WORDS or self.depth >= S.SCROLL
        read = enough and self.focused >= S.DWELL_MS
        pause = min(S.TICK_MS << max(0, self.offers - 1), S.OFFER_GAP_MS)
        new = replace(self, offers=self.offers + 1, offered_at=self.depth, wait=self.focused + pause, closed=bool(tick.refusal or read))
        return new, tick.refusal or ("read" if read else "still reading")


def _ms(tick: Row) -> int:
    return int(tick.ts.timestamp() * 1000 + 0.5)


class _Timed(StatefulProcessor):
    """One row of state a key, dropped ``idle_ms`` after the key's latest tick."""

    def __init__(self, schema: str, idle_ms: int):
        self.schema, self.idle_ms = schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.schema + ", expires long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = tuple(self.held.get()) if self.held.exists() else None
        state, out, latest = old[:-1] if old else None, [], old[-1] - self.idle_ms if old else 0
        for tick in sorted(rows, key=lambda r: r.ts):  # the ticks of one key in one micro-batch
            state, said = self.step(key, state, tick)
            out += said
            latest = max(latest, _ms(tick))
        if old:
            self.handle.deleteTimer(old[-1])
        expires = max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(expires)
        self.held.update((*state, expires))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Offers(_Timed):
    def step(self, key, state, tick):
        now = Reading(*state).after(tick) if state else Reading(tick.url.partition("#")[0], _ms(tick))
        if not now.due:
            return astuple(now), []
        now, said = now.offered(tick)
        return astuple(now), [Row(tab=key[0], page=now.page, focused_ms=now.focused, scroll=now.depth, capture=said == "read" and not tick.refusal, reason=said)]


class _Dwell(_Timed):
    def __init__(self, schema: str, idle_ms: int, most: int, offer: int):
        super().__init__(schema, idle_ms)
        self.most, self.offer = most, offer

    def step(self, key, state, tick):
        ms = _ms(tick)
        if state is None or state[0] != tick.page:
            return (tick.page, ms, 0), []
        page, last, focused = state
        now = focused + min(max(ms - last, 0), self.most)
        reached = focused < self.offer <= now
        return (page, max(ms, last), now), [Row(user_id=key[0], page=page, focused_ms=now)] * reached


def _keyed(ticks: DataFrame, key: str, late: str):
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return ticks.withWatermark("ts", late).groupBy(key)


def offers_stream(ticks: DataFrame, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """Offers of a stream of ticks (tab, url, ts, visible, scroll, words, pdf, refusal), by tab.

    A page is offered from ``OFFER_FLOOR_MS`` in focus on; while it is still being read,
    offers come less and less often, up to one in ``OFFER_GAP_MS``, and at once after a
    scroll of ``SCROLL_STEP``.  ``refusal`` is the policy's reason against the page, or null
    (``rules.reason`` on the stream gives it).
    """
    schema = "page string, last long, focused long, depth double, offers int, wait long, offered_at double, closed boolean"
    return _keyed(ticks, "tab", late).transformWithState(_Offers(schema, idle_ms), "tab long, page string, focused_ms long, scroll double, capture boolean, reason string", "append", "eventTime")


def dwell_stream(ticks: DataFrame, most: int = TICK_MS, offer: int = OFFER_MS, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """Stream form over (user_id, page, ts): a row each time a page's focused time first reaches ``offer``."""
    return _keyed(ticks, "user_id", late).transformWithState(_Dwell("page string, last long, focused long", idle_ms, most, offer), "user_id long, page string, focused_ms long", "append", "eventTime")


def once(pages: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of captured pages (with ``ts``) in which one content of one address passes once within ``late``, whatever sources file it.

    Keys and hashes are held until the watermark has passed them.  Pages without an
    http(s) address are left out.
    """
    from pagevault.operators.store import keyed

    return keyed(pages).withWatermark("ts", late).dropDuplicatesWithinWatermark(["url_key", "content_hash"])
