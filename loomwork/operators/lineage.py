"""Where iterative operators cut their lineage."""

import tempfile


def checkpoint_dir(spark):
    """The shared checkpoint folder of the cluster; a local session without one takes a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomwork-"))
    return sc.getCheckpointDir()


def shuffled(df):
    """``df`` to be joined by shuffles, not broadcast: Spark takes rows that are parsed or exploded from a small file for as few as the file's."""
    return df.hint("merge")


def cut(df):
    """``df`` written to the checkpoint folder and read from there from now on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
