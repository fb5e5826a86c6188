from signalloom.streaming.traces import running_best


def test_running_best(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("run_id,epoch,best\nx,1,5\nx,2,3\ny,1,7\n")
    q = running_best(spark, str(tmp_path / "in"), "run_id string, epoch int, best double").writeStream.outputMode("complete").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(x) for x in spark.table("best").collect()} == {("x", 3.0, 2), ("y", 7.0, 1)}
