"""One archive in one folder: everything a caller can ask for, in one object.

Pages are a versioned table; settings and sweep state are numbered texts; the
deletion log is a table that is only appended to.  Whatever deletes leaves a row
in the log.  Each change is one new version, published whole or not at all; it
reads and writes the parts of the archive that hold the pages it changes, and the
index follows part by part.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta, timezone, tzinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault import schemas as S
from pagevault import settings as P
from pagevault.functions import rules as R
from pagevault.functions import text as X
from pagevault.functions import urls as U
from pagevault.functions.query import parse
from pagevault.operators import capture as C
from pagevault.operators import index as I
from pagevault.operators import retention as K
from pagevault.operators import search as Q
from pagevault.operators import store as O
from pagevault.operators import versions as V
from pagevault.operators.index import Index
from pagevault.operators.scratch import settle
from pagevault.operators.stemming import stem_udf
from pagevault.sources import exports as E

HOST = re.compile(r"[a-z0-9][a-z0-9.-]*", re.I)
SWEPT = ("age", "size", "both")


class Engine:
    """``bundles`` are the rules of the exclusion bundles (``functions.presets``); ``clock`` gives milliseconds."""

    def __init__(self, spark: SparkSession, path: str, bundles: Mapping[str, Iterable[str]] | None = None, clock=None, tz: tzinfo = timezone.utc):
        self.spark, self.path, self.bundles, self.tz = spark, path.rstrip("/"), bundles, tz
        self.now = clock or (lambda: int(time.time() * 1000))

    # --- settings and state ---

    def _journal(self, name: str) -> V.Journal:
        return V.Journal(self.spark, f"{self.path}/{name}")

    def settings(self) -> P.Settings:
        return P.normalised(json.loads(self._journal("settings").newest() or "null"))

    def set_settings(self, patch: dict) -> P.Settings:
        new = P.updated(self.settings(), patch)
        self._journal("settings").append(new.json())
        return new

    def state(self) -> P.State:
        return P.state(json.loads(self._journal("state").newest() or "null"))

    def _set_state(self, **changes) -> P.State:
        new = self.state().but(**changes)
        self._journal("state").append(new.json())
        return new

    def _policy(self) -> dict:
        return self.settings().policy(self.now(), self.bundles)

    # --- pages ---

    @property
    def _pages(self) -> str:
        return f"{self.path}/archive"

    def archive(self, parts: list[int] | None = None) -> DataFrame:
        """The current version, or some of its parts."""
        return V.current(self.spark, self._pages, parts=parts)

    def _publish(self, table: DataFrame, parts: list[int] | None = None) -> None:
        """A new version, of the whole archive or of the parts that change."""
        held = V.pointers(self.spark, self._pages).numbers()
        V.publish(table, self._pages, f"version-{(held[-1] if held else 0) + 1:09d}-{uuid.uuid4().hex[:8]}", parts=parts)

    def _touched(self, keys: DataFrame) -> tuple[list[int], int]:
        """The parts that pages with these keys, or new ones, are in, and the last id."""
        held = self.archive()
        return V.around(self.spark, self._pages, O.matching(held, settle(keys, "keys"))), O.last_id(held)

    def _fold(self, pages: DataFrame, parts: list[int], top: int) -> None:
        near = self.archive(parts)
        self._publish(C.measured(near, settle(O.upsert(near, pages, top=top), "upserted")), parts)

    def index(self) -> Index:
        """The index of the current version; parts that were not indexed yet are when it is first asked for."""
        held = V.current_version(self.spark, self._pages)
        if held is None or held[1] == V.EMPTY:
            return Index.of(self.archive())
        parts, where = V.part_list(self.spark, self._pages, held[1]), f"{self.path}/index"
        if parts is None:
            return Index.of(self.archive())
        for v in sorted(set(parts.values())):
            fs, done = V.file_system(self.spark, f"{where}/{v}/terms/_SUCCESS")
            if not fs.exists(done):
                I.save_parts(self.archive([p for p, x in parts.items() if x == v]), f"{where}/{v}")
        return I.load_parts(self.archive(), where, parts)

    def upgrade(self, migrations=()) -> list[str]:
        return V.upgrade(self.spark, self._pages, migrations)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions, parts and indexes that the newest ``keep`` versions don't need; no reader may be at older ones."""
        self.index()  # the dictionary counts off what replaced parts held before they go
        gone = V.vacuum(self.spark, self._pages, keep)
        I.vacuum_parts(self.spark, f"{self.path}/index", V.needed(self.spark, self._pages))
        return gone

    # --- reading ---

    def search(self, text: str, limit: int = S.PAGE, offset: int = 0, recent: bool = False, snippets: bool = True, **filters) -> DataFrame:
        languages = self.settings().stem_languages
        more = {"languages": languages, "stem": stem_udf} if languages else {}
        return Q.search(self.index(), [(0, parse(text, self.now(), self.tz))], self.now(), limit, offset, recent, snippets, **filters, **more)

    def omnibox(self, text: str) -> DataFrame:
        """The first six results as (content, description) with escaped markup; none for a blank text."""
        if not text.strip():
            return self.spark.createDataFrame([], "content string, description string")
        safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        name = F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title"))
        found = self.search(text, S.OMNIBOX, snippets=False).orderBy("rank")
        return found.select(F.col("url").alias("content"), F.concat(F.lit("<match>"), safe(name), F.lit("</match> <dim>"), safe(F.col("domain")), F.lit("</dim>")).alias("description"))

    def recent(self, limit: int = S.PAGE) -> DataFrame:
        return O.recent(self.archive(), limit)

    def stats(self) -> dict:
        s, state, now = self.settings(), self.state(), self.now()
        row = K.overview(self.archive(), now, int(s.size_cap_bytes)).first().asDict()
        return row | {"paused": s.paused(now), "mode": s.mode, "at_cap": row["level"] == "over" and not state.cap_unmeetable, "cap_unmeetable": state.cap_unmeetable, "clock_problem": state.clock_problem,
                      "new_bundles": list(state.new_bundles), "recent_evictions": [r.asDict() for r in self.log(5).collect()]}

    def log(self, limit: int = S.LOG_READ) -> DataFrame:
        """The newest deletions; rounds of sweeps that follow each other closely are one row."""
        fs, p = V.file_system(self.spark, f"{self.path}/log")
        rows = self.spark.read.schema(S.LOG).parquet(f"{self.path}/log") if fs.exists(p) else self.spark.createDataFrame([], S.LOG)
        swept = K.merged_log(rows.where(F.col("reason").isin(*SWEPT)))
        return K.read_log(swept.select(*S.LOG.names).unionByName(rows.where(~F.col("reason").isin(*SWEPT))), limit)

    def _log(self, reason: str, count: int, freed: int, age: int = 0, size: int = 0) -> None:
        at = self.now()
        self.spark.createDataFrame([(time.time_ns(), at, reason, count, freed, age, size, 1)], S.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def page_statuses(self, pages: DataFrame) -> DataFrame:
        """Pages (``url`` and other columns) with ``domain``, ``kept`` (the page as it is held, or null), ``capturable``, ``reason`` and ``excluded``."""
        policy = self._policy()
        broad = R.reason(F.col("url"), **(policy | {"allowlist": None}))
        held = self.archive().select(F.col("url_key").alias("_of"), F.struct("id", "last_seen", "visit_count", "pinned").alias("kept"))
        asked = pages.withColumns({"domain": U.domain_of(F.col("url")), "reason": R.reason(F.col("url"), **policy), "_broad": broad, "_key": U.url_key(F.col("url"))})
        shut = F.col("_broad").startswith("excluded") | F.col("_broad").startswith("the address contains")
        met = asked.join(held, F.col("_key") == F.col("_of"), "left").withColumns({"capturable": F.col("reason") == "ok", "excluded": F.when(shut, F.col("_broad"))})
        return met.drop("_broad", "_key", "_of")

    def page_status(self, url: str) -> dict:
        """Whether a page is kept, and whether it would be."""
        r = self.page_statuses(self.spark.createDataFrame([(url,)], "url string")).first().asDict(recursive=True)
        return {"url": url, "domain": r["domain"], "mode": self.settings().mode, "kept": r["kept"], "capturable": r["capturable"], "reason": r["reason"], "excluded": r["excluded"]}

    # --- changing ---

    def restore(self, pages: DataFrame) -> None:
        """Put a table of pages (``schemas.ARCHIVE``) in place of the archive, as one version; columns that follow from others may be missing."""
        text = X.indexed_text(F.col("title"), F.col("text"))
        follows = {
            "url_key": U.url_key(F.col("url")), "domain": U.domain_of(F.col("url")), "excerpt": X.excerpt(F.col("text")), "content_hash": X.content_hash(text), "lang": F.lit(None),
            "word_count": X.count_terms(text), "bytes": X.byte_length(F.col("text")),
        }
        whole = pages.withColumns({c: x for c, x in follows.items() if c not in pages.columns})
        self._publish(whole.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.ARCHIVE.fields]))

    def pin(self, id: int, value: bool = True) -> None:
        parts = [id >> V.PART_BITS]
        self._publish(O.pin(self.archive(parts), id, value), parts)

    def _remove(self, ids: DataFrame, reason: str) -> dict:
        """Delete pages in one version and log it; nothing happens where none of the ids is a page."""
        ids = settle(ids.select("id"), "gone")
        parts = V.parts_of(ids)
        held = self.archive(parts)
        n = O.deletion(held, ids).first().asDict()
        if n["deleted"]:
            self._publish(O.without(held, ids), parts)
            self._log(reason, n["deleted"], n["bytes_freed"])
        return n

    def forget(self, scope: str, value: object) -> dict:
        """Delete a page by id, a site with what is below it, or a calendar day of the archive's time zone."""
        a = self.archive()
        if scope == "page":
            ids = a.where(F.col("id") == value)
        elif scope == "site":
            ids = a.where(O.on_site(str(value)))
        elif scope == "day":
            try:
                d = datetime.fromisoformat(str(value)).date()
            except ValueError:
                return {"deleted": 0, "bytes_freed": 0}
            start = lambda day: int(datetime(day.year, day.month, day.day, tzinfo=self.tz).timestamp() * 1000)
            ids = a.where(O.between(start(d), start(d + timedelta(days=1))))
        else:
            raise ValueError(f"nothing to forget by {scope}")
        return self._remove(ids, "manual")

    def wipe(self) -> dict:
        """Delete every page; always logged."""
        held = self.archive()
        n = held.agg(F.count(F.lit(1)).alias("deleted"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_freed")).first().asDict()
        self._publish(held.limit(0))
        self._log("manual", n["deleted"], n["bytes_freed"])
        return n

    def capture(self, contents: DataFrame) -> DataFrame:
        """File captured contents; every row's outcome comes back."""
        canonical = U.canonical_for(F.col("url"), F.coalesce("canonical", F.lit("")))
        parts, top = self._touched(contents.select(F.explode(F.array(U.url_key(F.col("url")), U.url_key(canonical))).alias("url_key")))
        judged = settle(C.contents(contents, self.archive(parts), self._policy(), self.now()), "judged")
        self._fold(C.as_pages(judged), parts, top)
        return judged

    def capture_now(self, contents: DataFrame) -> DataFrame:
        """File pages that the reader asked for: short texts and much smaller ones count, the rules still hold."""
        return self.capture(contents.withColumn("explicit", F.lit(True)))

    def offers(self, candidates: DataFrame) -> DataFrame:
        return C.offers(candidates, self._policy())

    def import_pages(self, rows: DataFrame) -> dict[str, int]:
        """Import rows with ``arrival``; the exclusions hold, a pause or the mode don't.  How many came to which end."""
        parts, top = self._touched(rows.select(U.url_key(F.col("url")).alias("url_key")))
        verdict = R.reason(F.col("url"), self.settings().rules(self.bundles))
        judged = settle(C.imports(rows, self.archive(parts), verdict != "ok", self.now()), "imports")
        self._fold(judged.where("stored").select(*C.PAGE, "arrival"), parts, top)
        tally = {r.status: r.n for r in judged.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {k: tally.get(k, 0) for k in ("imported", "skipped", "failed", "excluded")}

    def export(self, path: str, document: bool = False) -> dict:
        s = json.loads(self.settings().json())
        said = {k: s[k] for k in ("mode", "retention_months", "size_cap_bytes", "presets", "custom_rules")}
        at = datetime.fromtimestamp(self.now() / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return (E.write_document if document else E.write)(self.archive(), path, at, said)

    def sweep(self) -> dict:
        """Apply the storage budget once: the age rule (unless the clock can't be trusted), then the size rule."""
        s, state, now = self.settings(), self.state(), self.now()
        problem, hold = K.clock_hold(now, int(state.last_sweep) or None, int(state.clock_hold_until) or None, state.clock_problem)
        held = self.archive()
        total = held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        plan = settle(K.plan(held, now, s.retention_months, int(s.size_cap_bytes), apply_age=not problem), "plan")
        n = K.summary(plan).first()
        evicted = n["age"] + n["size"]
        if evicted:
            parts = V.parts_of(plan)
            self._publish(O.without(self.archive(parts), plan), parts)
            self._log(n["reason"], evicted, n["bytes_freed"], n["age"], n["size"])
        unmeetable = total - n["bytes_freed"] > s.size_cap_bytes
        self._set_state(last_sweep=now, cap_unmeetable=unmeetable, clock_problem=problem, clock_hold_until=hold)
        return {"evicted": evicted, "bytes_freed": n["bytes_freed"], "reason": n["reason"], "unmeetable": unmeetable, "clock_problem": problem}

    # --- exclusions ---

    def allow_site(self, domain: str) -> P.Settings:
        s = self.settings()
        return self.set_settings({"allowlist": [*s.allowlist, domain]}) if HOST.fullmatch(domain or "") and domain not in s.allowlist else s

    def block_site(self, domain: str, dry_run: bool = False) -> dict:
        """Add a rule for a site and delete it with everything below it; a dry run only counts."""
        if not HOST.fullmatch(domain or ""):
            return {"removed": 0}
        ids = self.archive().where(O.on_site(domain))
        if dry_run:
            return {"would_remove": ids.count()}
        s = self.settings()
        self.set_settings({"custom_rules": list(dict.fromkeys([*s.custom_rules, domain])), "allowlist": [x for x in s.allowlist if x != domain]})
        return {"removed": self._remove(ids, "siteRule")["deleted"]}

    def remove_excluded(self, scope: str, name: str | None = None, dry_run: bool = False, keep_existing: bool = False) -> dict:
        """Apply rules in force to what is kept: of one bundle, the custom ones, or (shipped) all bundles' new ones and the key check."""
        s, state = self.settings(), self.state()
        secrets, marking, settled = False, [], None
        if scope == "preset":
            everything = P.rules_for({name: True}, (), self.bundles)
            if keep_existing:
                self._applied(everything, name)
                return {"matched": 0, "removed": 0, "kept": True}
            rules = marking = everything if s.presets.get(name) else []
            settled = name
        elif scope == "custom":
            rules = list(s.custom_rules)
        elif scope == "shipped":
            marking = P.rules_for({k: v for k, v in s.presets.items() if k not in state.new_bundles}, (), self.bundles)
            rules, secrets = [r for r in marking if r not in set(state.applied_rules)], True
        else:
            raise ValueError(f"no rules by the scope {scope}")
        if not rules and not secrets:
            return {"matched": 0, "removed": 0}
        url = F.col("url") if secrets else F.col("url_key")  # a key can stand in the fragment, which the key drops
        hit = R.any_match(url, rules) | (R.secret_in_url(url) if secrets else F.lit(False))
        ids = settle(self.archive().where(hit).select("id"), "excluded")
        matched = ids.count()
        if dry_run:
            return {"matched": matched, "removed": 0}
        removed = self._remove(ids, "siteRule")["deleted"]
        self._applied(marking, settled)
        return {"matched": matched, "removed": removed}

    def _applied(self, rules: Iterable[str], settled: str | None) -> None:
        state = self.state()
        self._set_state(applied_rules=tuple(dict.fromkeys([*state.applied_rules, *rules])), new_bundles=tuple(x for x in state.new_bundles if x != settled))

    def note_new_bundles(self) -> list[str]:
        """Bundles that the stored settings don't know: on from now, but what they cover from before waits for an answer."""
        raw = json.loads(self._journal("settings").newest() or "null")
        if not isinstance(raw, dict) or not isinstance(raw.get("presets"), dict):
            return []
        added = [k for k in P.BUNDLES if k not in raw["presets"]]
        if added:
            self._set_state(new_bundles=tuple(dict.fromkeys([*self.state().new_bundles, *added])))
            self.set_settings({})
        return added

    def every(self, interval: str = "1 hour", **options):
        """A stream whose only work is a sweep at each trigger; it goes on where a restart left it."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = ticks.writeStream.foreachBatch(lambda _, __: self.sweep()).option("checkpointLocation", f"{self.path}/sweeps")
        return writer.trigger(**(options or {"processingTime": interval})).start()
