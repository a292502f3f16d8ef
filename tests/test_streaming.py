import json
import os

import pytest
from pyspark.sql import functions as F

from pursebook.plans import insight_queries
from pursebook.streaming import ingest as si

RAW = "user_id string, key string, arrival int, text string, balance long"
LEDGER = "user_id string, dedupe_key string, arrival int, id int, description_raw string, balance_after_paisa long, reference string, counterparty string, channel string"


def parse(batch):
    none = F.lit(None).cast("string")
    return batch.select("user_id", F.col("key").alias("dedupe_key"), "arrival", F.col("arrival").alias("id"), F.col("text").alias("description_raw"), F.col("balance").alias("balance_after_paisa"), none.alias("reference"), none.alias("counterparty"), none.alias("channel"))


@pytest.fixture
def world(spark, tmp_path):
    inbox, ledger = tmp_path / "in", str(tmp_path / "ledger")
    inbox.mkdir()

    class World:
        folder, parsed = ledger, []

        def put(self, name, *rows):
            (inbox / name).write_text("\n".join(json.dumps(r) for r in rows))

        def run(self, checkpoint="c"):
            seen = lambda b: (self.parsed.append(b.count()), parse(b))[1]
            si.ingest_available(spark, str(inbox), RAW, ledger, str(tmp_path / checkpoint), seen).awaitTermination()
            return self.rows()

        def rows(self):
            return sorted(map(str, si.read_ledger(spark, ledger, LEDGER).collect()))

        def deltas(self):
            return si.deltas(spark, ledger, {})

        def forget_commit(self, checkpoint="c"):
            """As if the run had stopped after the batch's write and before Spark's commit."""
            commits = sorted((tmp_path / checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last = commits[-1]
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
            return int(last.name)

    return World()


ROW = {"user_id": "u", "key": "k", "arrival": 1, "text": "ab"}


def test_batches_are_appended_and_folded_by_key(world, spark):
    world.put("1.json", ROW, {"user_id": "u", "key": "m", "arrival": 2, "text": "x", "balance": 3})
    assert len(world.run()) == 2
    world.put("2.json", {**ROW, "arrival": 5, "text": "abc", "balance": 9})
    second = world.run()
    assert len(second) == 2 and any("abc" in r and "balance_after_paisa=9" in r for r in second)
    assert len(world.deltas()) == 2 and world.run() == second
    assert world.run("fresh") == second and len({s for s, _ in world.deltas()}) == 2


def test_a_message_that_comes_again_is_not_parsed_again(world):
    world.put("1.json", ROW, ROW)
    first = world.run()
    world.put("2.json", ROW, {**ROW, "key": "n"})
    assert len(world.run()) == 2 and world.parsed == [1, 1] and set(first) < set(world.rows())


def test_a_stop_between_write_and_commit(world, spark):
    world.put("1.json", ROW)
    world.run()
    world.put("2.json", {**ROW, "key": "n"}, ROW)
    before = world.run()
    number = world.forget_commit()
    # The batch runs again, with the state of before: it writes the same rows in the same place.
    assert world.run() == before and world.parsed[-2:] == [1, 1] and [n for _, n in world.deltas()] == list(range(number + 1))
    # If a base has taken it in meanwhile, it is skipped.
    world.forget_commit()
    si.compact(spark, world.folder, LEDGER)
    parsed = len(world.parsed)
    assert world.run() == before and len(world.parsed) == parsed


def test_compaction(world, spark):
    for k in range(4):
        world.put(f"{k}.json", {**ROW, "key": f"k{k % 3}", "arrival": k, "text": "a" * (k + 1), "balance": k})
        before = world.run()
        si.compact(spark, world.folder, LEDGER)
        assert world.rows() == before
    assert si.bases(spark, world.folder) == [2, 3] and [n for _, n in world.deltas()] == [3]
    si.compact(spark, world.folder, LEDGER)
    assert si.bases(spark, world.folder) == [2, 3]
    # A base without what it covers is not there.
    os.remove(f"{world.folder}/base/v=3/covered/_SUCCESS")
    assert si.bases(spark, world.folder) == [2] and world.rows() == before


def test_an_empty_ledger(world, spark):
    assert world.rows() == []
    si.compact(spark, world.folder, LEDGER)
    assert si.bases(spark, world.folder) == []


def test_settings_are_put_back(world, spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    world.put("1.json", ROW)
    world.run()
    assert spark.conf.get(key) == before != si.STATE_STORE[key]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_events_streamed_twice_are_new_once(spark):
    first, again, fresh = insight_queries.events_streamed_twice(spark, "/root/testdata/sf0.001").orderBy("run").collect()
    assert first.new_rows == first.ledger_rows > 0 and first.new_gaps == first.gaps > 0
    for r in (again, fresh):
        assert (r.ledger_rows, r.gaps, r.new_rows, r.new_gaps) == (first.ledger_rows, first.gaps, 0, 0)
    assert (again.parsed, fresh.parsed) == (0, first.parsed)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_gaps_are_looked_for_in_a_ledger_that_is_folded_already(spark, monkeypatch):
    plans, find = [], insight_queries.reconcile.find_gaps
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(insight_queries.reconcile, "find_gaps", lambda rows: (plans.append(plan(rows)), find(rows))[1])
    assert insight_queries.events_streamed_twice(spark, "/root/testdata/sf0.001").count() == 3
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)
