import os
import tempfile

import pandas as pd

from refinery.operators.answers import resolve_resumable

ROWS = [(i % 23, ["fr", "de", None][i % 3], i) for i in range(200)]


def keys_frame(spark):
    return spark.createDataFrame(ROWS, "city int, `c.o` string, answer int").withColumnRenamed("c.o", "country")


def logged(folder, fails=0, broken=()):
    """A resolver that notes every key it is asked, fails its first calls of a batch, and always for some cities."""
    def run(asked: pd.DataFrame) -> pd.Series:
        first = f"{asked['city'].iloc[0]}-{asked['country'].iloc[0]}"
        with open(os.path.join(folder, f"{first}.log"), "a") as f:
            f.write(f"{len(asked)}\n")
        with open(os.path.join(folder, f"{first}.log")) as f:
            calls = len(f.readlines())
        if calls <= fails or set(asked["city"]) & set(broken):
            raise RuntimeError("service down")
        return asked["city"].map(lambda c: None if c == 3 else "''" if c == 4 else f"town {c}")
    return run


def calls(folder):
    return {f: len(open(os.path.join(folder, f)).readlines()) for f in os.listdir(folder)}


def expected(city):
    return None if city in (3, 4) else f"Town {city}"


def test_retries_then_answers_and_never_asks_again(spark):
    path, log = tempfile.mkdtemp(prefix="refinery-answers-"), tempfile.mkdtemp(prefix="refinery-log-")
    df = keys_frame(spark)
    out = resolve_resumable(df, ["city", "country"], logged(log, fails=2), path, batch_rows=10, pause_s=0.01).collect()
    assert sorted((r.city, r.country or "", r.answer, r.match) for r in out) == \
        sorted((c, k or "", n, expected(c)) for c, k, n in ROWS)
    assert all(r.resolve_error is None for r in out)
    n = calls(log)
    assert len(n) == 7 and set(n.values()) == {3}  # 69 keys in batches of ten, twice failed, then answered
    again = resolve_resumable(df, ["city", "country"], logged(log), path, batch_rows=10).collect()
    assert calls(log) == n and sorted(map(str, again)) == sorted(map(str, out))


def test_failed_batches_are_asked_anew(spark):
    path, log, log2 = (tempfile.mkdtemp(prefix="refinery-answers-") for _ in range(3))
    df = keys_frame(spark)
    out = resolve_resumable(df, ["city"], logged_city(log, {5}), path, batch_rows=1, tries=2, pause_s=0.01).collect()
    assert {(r.city, r.match, r.resolve_error) for r in out if r.city == 5} == {(5, None, "service down")}
    assert all(r.match == expected(r.city) and r.resolve_error is None for r in out if r.city != 5)
    later = resolve_resumable(df, ["city"], logged_city(log2, set()), path, batch_rows=1).collect()
    assert all(r.match == expected(r.city) and r.resolve_error is None for r in later)
    assert list(calls(log2)) == ["5.log"]


def logged_city(folder, broken):
    def run(asked: pd.DataFrame) -> pd.Series:
        with open(os.path.join(folder, f"{asked['city'].iloc[0]}.log"), "a") as f:
            f.write("1\n")
        if set(asked["city"]) & broken:
            raise RuntimeError("service down")
        return asked["city"].map(lambda c: None if c == 3 else "''" if c == 4 else f"town {c}")
    return run


def test_nothing_to_ask(spark):
    path = tempfile.mkdtemp(prefix="refinery-answers-")
    out = resolve_resumable(keys_frame(spark).limit(0), ["city"], lambda d: 1 / 0, path)
    assert out.count() == 0 and out.columns == ["city", "country", "answer", "match", "resolve_error"]
