"""Tables of scopes: two threads do not take each other's."""

import threading
from urllib.parse import urlparse

from sheaf.session import scratch, written
from sheaf.sources import files


def test_scopes_of_threads_are_apart(spark):
    left, ready, go = {}, threading.Barrier(2), threading.Barrier(2)

    def work(name):
        with scratch(spark):
            t = written(spark.range(3), f"own-{name}")
            path = urlparse(t.inputFiles()[0]).path.rsplit("/", 1)[0]
            ready.wait(60)
            if name == "b":
                go.wait(60)
                left["while a has ended"] = t.count()
        left[name] = files.exists(spark, path)
        if name == "a":
            go.wait(60)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert left == {"a": False, "b": False, "while a has ended": 3}


def test_kept_tables_outlive_their_scope(spark):
    with scratch(spark):
        with scratch(spark):
            t = written(spark.range(4), "kept", keep=True)
        assert t.count() == 4
        path = urlparse(t.inputFiles()[0]).path.rsplit("/", 1)[0]
    assert not files.exists(spark, path)
