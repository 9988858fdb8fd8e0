"""Change feed as a keyed table: the batch fold, its streaming twin, and a plain replay."""

import json
import random

from pyspark.sql import functions as F

from paceline.catalog.streams import folder
from paceline.operators import feed
from paceline.sources import feeds
from paceline.streaming import serve, stateful
from tests.test_streaming import Files, drain

LOG = "race_id bigint, change_seq bigint, type string, id string, fields map<string,string>"
WIRE = {c: w for c, (w, _) in feed.FIELDS.items()}


def random_log(seed, n):
    rng, rows = random.Random(seed), []
    for at in range(1, n + 1):
        race = rng.randrange(2)
        kind = rng.choices(["add", "update", "delete", "reload", "other"], [6, 6, 2, 0.3, 0.3])[0]
        values = {
            "bibNumber": str(rng.randrange(30)), "racerName": rng.choice(["Ann", None]), "finishTime": rng.choice(["100.5", "7", "bad", None]),
            "rank": rng.choice(["3", None, "x"]), "age": rng.choice(["41", None]), "team": rng.choice(["T", None, ""]),
        }
        given = {k: v for k, v in values.items() if rng.random() < 0.5}
        gone = kind == "reload" or rng.random() < 0.02
        rows.append((race, at, kind, None if gone else f"i{rng.randrange(12)}", rng.choice([given, given, given, None])))
    return rows


def replay(rows):
    """One message after another, as a subscriber would."""
    table = {}
    for race, at, kind, id_, given in sorted(rows, key=lambda r: r[1]):
        if kind == "reload":
            table = {k: v for k, v in table.items() if k[0] != race}
        elif id_ is not None and kind == "delete":
            table.pop((race, id_), None)
        elif id_ is not None and kind in ("add", "update"):
            row = table.setdefault((race, id_), {"seq": at})
            row |= given or {}
            row["version"] = at
    return table


def number(text, kind):
    try:
        return None if text is None else kind(text)
    except ValueError:
        return None


def plain(rows):
    kinds = {"finish_time_ms": float, "rank": int}
    return {
        key: (*(number(row.get(w), kinds.get(c, str)) for c, w in WIRE.items()), row["seq"], row["version"])
        for key, row in replay(rows).items()
    }


def table(df):
    rows = df.collect()
    out = {(r["race_id"], r["id"]): tuple(r[c] for c in feed.COLUMNS[2:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_fold(spark):
    for seed in range(3):
        rows = random_log(seed, 250)
        assert table(feed.fold_feed(spark.createDataFrame(rows, LOG))) == plain(rows)
    assert feed.fold_feed(spark.createDataFrame([], LOG)).count() == 0


def test_stream_restarts_and_repeats(spark):
    """After every restart the table is the replay so far; changes sent again do nothing."""
    rows = random_log(7, 300)
    source, out, checkpoint = Files(spark, LOG), folder(spark, "out"), folder(spark, "ck")
    done = 0
    for cut in (90, 91, 200, 300):
        again = rows[max(0, done - 20) : done]
        source.add(random.Random(cut).sample(again + rows[done:cut], len(again) + cut - done))
        drain(stateful.stream_feed(source.stream()), serve.table_writer(out), checkpoint)
        done = cut
        sent = spark.read.parquet(out)
        assert table(feed.live_table(sent)) == plain(rows[:cut])
    assert sent.columns[0] == "race_id" and sent.where("id = 'i3'").count() <= 8  # a row per batch, not per change


def test_stream_spreads_a_race(spark, monkeypatch, tmp_path):
    """One race's changes do not meet in one call; late changes count unless a reload came."""
    sizes = str(tmp_path / "sizes")

    class Counting(stateful.GenerationProcessor):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            with open(sizes, "a") as log:
                log.write(f"{sum(map(len, rows))}\n")
            yield from super().handleInputRows(key, iter(rows), timerValues)

    monkeypatch.setattr(stateful, "GenerationProcessor", Counting)
    give = lambda i, n: (0, n, "add", f"i{i}", {"team": str(n)})
    first = [give(n % 500, n) for n in range(1, 2001)] + [(0, 2001, "reload", None, None)]
    first += [give(n % 500, n) for n in range(2002, 3000)] + [give(7, 3002)]
    late = [give(900, 5), give(7, 3001), give(901, 3000)]
    source, out, checkpoint = Files(spark, LOG), folder(spark, "out"), folder(spark, "ck")
    for rows in (first, late):
        source.add(rows)
        drain(stateful.stream_feed(source.stream()), serve.table_writer(out), checkpoint)
    assert table(feed.live_table(spark.read.parquet(out))) == plain(sorted(first + late, key=lambda r: r[1]))
    with open(sizes) as log:
        assert max(int(n) for n in log) <= len(first) // 8


def test_messages_keep_cleared_fields(spark, rows_of):
    """A null that is sent clears the field; a field that is not sent stays."""
    schema = "race_id bigint, id string, bib_number string, racer_name string, finish_time_ms double, rank bigint, gender string, team string, age string"
    before = rows_of(schema, (0, "a", "5", "Ann", 100.0, 1, "W", "T", "41"), (0, "b", "6", "Bo", 200.0))
    after = rows_of(schema, (0, "a", "5", "Ann", 100.0, 1, "W", None, None))
    sent = [
        *[r.value for r in feeds.add_messages(before).collect()],
        *[r.value for r in feeds.edit_messages(after.withColumn("notify", F.lit("update"))).collect()],
        *[r.value for r in feeds.delete_messages(rows_of("race_id bigint, id string", (0, "b"))).collect()],
        json.dumps({"type": "update", "data": {"id": "c", "finishTime": 70000}}),
        json.dumps({"type": "clock_update", "data": {"status": "running"}}),
    ]
    messages = spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(sent)], "race_id bigint, change_seq bigint, value string")
    got = table(feed.fold_feed(feeds.change_feed(messages)))
    assert got == {
        (0, "a"): ("5", "Ann", 100.0, 1, "W", None, None, 1, 3),
        (0, "c"): (None, None, 70000.0, None, None, None, None, 5, 5),
    }
    reload = spark.createDataFrame([(0, 9, '{"action": "reload"}')], messages.schema)
    assert feed.fold_feed(feeds.change_feed(messages.union(reload))).count() == 0
