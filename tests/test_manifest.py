"""The stored manifest: only changed logs are read, versions replace each other whole, odd logs stay as rows."""

import os
import shutil
import time

from rangeflow.sources import manifest as M
from rangeflow.sources import recording_source as R

from .test_recording_source import messages


def rows(df):
    return sorted((r.path.split("/")[-2:], r.topic or "", r.n or -1, r.error is not None, r.read_in) for r in df.collect())


def test_only_what_changed_is_read(spark, tmp_path, monkeypatch):
    root, store = f"{tmp_path}/logs", f"file://{tmp_path}/manifest"
    os.makedirs(root)
    assert M.update_manifest(spark, root, store).count() == 0 and M.versions(spark, store) == [1]
    read = []
    count = M.count_messages
    monkeypatch.setattr(M, "count_messages", lambda files: read.append(files.count()) or count(files))
    df, _ = messages(spark, 120)
    df = df.withColumn("bag", M.F.translate("bag", " ", "_"))
    R.write_recordings(df.where("bag <> 'bag_2'"), root)
    first = rows(M.update_manifest(spark, root, store))
    assert read == [2] and len(first) == 8 and {r[-1] for r in first} == {2}
    assert rows(M.update_manifest(spark, root, store)) == first and read == [2] and M.versions(spark, store) == [1, 2]
    R.write_recordings(df.where("bag = 'bag_2'"), root)
    os.makedirs(f"{root}/odd")
    with open(f"{root}/odd/a.db3", "wb") as f:
        f.write(b"no log" * 500)
    second = M.update_manifest(spark, root, store)
    assert read == [2, 2] and M.versions(spark, store) == [2, 3] and rows(second)[:8] == first
    assert [r for r in rows(second) if r[3]] == [(["odd", "a.db3"], "", -1, True, 3)]
    shutil.rmtree(f"{root}/bag_0")
    time.sleep(1.1)
    os.utime(R.find_logs(f"{root}/bag_1")[0])
    third = rows(M.update_manifest(spark, root, store))
    assert read == [2, 2, 1] and {(tuple(r[0]), r[-1]) for r in third} == {(("bag_1", "bag_1_0.db3"), 4), (("bag_2", "bag_2_0.db3"), 3), (("odd", "a.db3"), 3)}


def test_a_run_that_broke_off_leaves_the_version_before(spark, tmp_path):
    root, store = f"{tmp_path}/logs", f"{tmp_path}/manifest"
    df, _ = messages(spark, 30, 1)
    R.write_recordings(df, root)
    one = rows(M.update_manifest(spark, root, store))
    os.makedirs(f"{store}/v2")
    with open(f"{store}/v2/part-0.parquet", "wb") as f:
        f.write(b"half a file")
    assert rows(M.read_manifest(spark, store)) == one
    with open(f"{root}/bag 0/more.db3", "wb") as f:
        f.write(b"x")
    assert len(M.update_manifest(spark, root, store).collect()) == len(one) + 1 and M.versions(spark, store) == [1, 2]
