"""The dictionary's runs: random changes of parts, merges, tombstones, lost words and dead writers."""

import random

import pytest

from pagevault.operators.dictionary import FAN, SCHEMA, Dictionary

WORDS = [f"w{k}" for k in range(12)]


def test_random_changes(spark, tmp_path):
    r = random.Random(5)
    versions: dict[tuple[int, str], dict[str, int]] = {}
    d = Dictionary(spark, f"file://{tmp_path}/d")

    def terms(parts):
        rows = [(w, n) for p, v in parts.items() for w, n in versions[p, v].items()]
        return spark.createDataFrame(rows, SCHEMA)

    parts, written = {}, []
    for step in range(9):
        for p in r.sample(range(4), r.randint(1, 2)):
            if step > 5 and r.random() < 0.4:
                parts.pop(p, None)
                continue
            was = versions.get((p, parts.get(p)), {})
            versions[p, f"v{step}"] = {w: n for w, n in ({**was, **{w: r.randint(0, 5) for w in r.sample(WORDS, 3)}}).items() if n}
            parts[p] = f"v{step}"
        want = {}
        for p, v in parts.items():
            for w, n in versions[p, v].items():
                want[w] = want.get(w, 0) + n
        before = {name for _, name in (d.state() or {"runs": []})["runs"]}
        assert dict(map(tuple, d.load(dict(parts), terms).collect())) == want
        runs = d.state()["runs"]
        assert all(sum(level == x for x, _ in runs) < FAN for level in {x for x, _ in runs})
        fresh = [name for level, name in runs if name not in before and level == 0]
        if step and fresh:  # a change writes words that it changes, and only those
            written.append(spark.read.parquet(f"file://{tmp_path}/d/{fresh[0]}").count())
        assert d.follow(dict(parts), terms) == runs  # nothing new, nothing written
    assert written and max(written) <= len(WORDS) and any(level for level, _ in d.state()["runs"])
    gone = d.vacuum()
    assert gone and dict(map(tuple, d.load(dict(parts), terms).collect())) == want


def test_lost_words_and_writers(spark, tmp_path, monkeypatch):
    d = Dictionary(spark, f"file://{tmp_path}/d")
    one, two = spark.createDataFrame([("a", 2), ("b", 1)], SCHEMA), spark.createDataFrame([("a", 1)], SCHEMA)
    assert dict(map(tuple, d.load({0: "x"}, lambda parts: one).collect())) == {"a": 2, "b": 1}
    # the replaced part's words are gone: the whole is summed anew
    assert dict(map(tuple, d.load({0: "y"}, lambda parts: None if "x" in parts.values() else two).collect())) == {"a": 1}
    with pytest.raises(ValueError, match="missing"):
        d.load({0: "z"}, lambda parts: None)
    held = d.state()
    append = type(d.journal).append
    monkeypatch.setattr(type(d.journal), "append", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        d.load({0: "x"}, lambda parts: one)
    monkeypatch.setattr(type(d.journal), "append", append)
    assert d.state() == held and len(d.vacuum()) >= 1
    assert Dictionary(spark, f"file://{tmp_path}/none").vacuum() == []
