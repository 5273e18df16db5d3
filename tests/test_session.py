"""The shared folder: a session's files and checkpoints go, those of other sessions stay."""

from pathlib import Path

from quern import session
from quern.operators import corpus


def test_remove_shared_leaves_nothing_of_this_session(spark):
    other = Path(session.checkpoint_root(spark).removeprefix("file://")) / session.FOLDER / "other-session"
    other.mkdir(parents=True, exist_ok=True)
    own = Path(session.session_folder(spark).removeprefix("file://"))
    d = spark.range(50).selectExpr("'c' corpus_id", "concat('p', id) path")
    cut = session.cut(d)
    d.write.parquet(session.shared_path(spark, "x"))
    assert corpus._numbered(d).count() == 50
    made = [Path(p.removeprefix("file:")) for p in spark.sparkContext._quern_checkpoints]
    assert len(made) >= 2 and all(p.exists() for p in made) and any(own.iterdir()) and cut.count() == 50
    session.remove_shared(spark)
    assert not any(p.exists() for p in made) and not own.exists() and other.exists()
    assert not list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("rdd-*")) and session.cut(d).count() == 50
    session.remove_shared(spark, every=True)
    assert not other.parent.exists()
