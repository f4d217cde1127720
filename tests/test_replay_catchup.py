"""A replay without pace: many staged files to a micro-batch, a folder for each of them."""

from checks import tables
from ledgerwatch.operators.replay import validate_replay
from ledgerwatch.streaming.replay import replay_paced, stage_replay

SF = "/root/testdata/sf0.001"


def test_replay_without_pace_takes_many_files_at_once(spark, folder):
    events = tables.replay_input(spark, SF)
    staged = stage_replay(events, f"{folder}/staged", 100, max_events=700)
    assert staged.batches == 7
    for run in range(2):  # the second from a lost checkpoint: every folder is written again
        query = replay_paced(spark, staged, f"{folder}/sent", f"{folder}/c{run}", "rp")
        query.awaitTermination()
        assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [700]
        sent = spark.read.schema("eventId string, batch long").json(f"{folder}/sent").collect()
        checked = validate_replay(events).select("eventId", "row_number", "replay_reason")
        first = enumerate(checked.orderBy("row_number").limit(700).collect())
        wanted = {("rp-" + r.eventId, k // 100) for k, r in first if r.replay_reason is None}
        assert {(r.eventId, r.batch) for r in sent} == wanted and len(sent) == len(wanted)
