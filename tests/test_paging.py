"""Paged interfaces: ranges, the end in three manners, repeats, retries and a stream."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemill.sources import paging


class Given(paging.Interface):
    """An interface over a list, that answers beyond its end with nothing, its last page or its first."""

    def __init__(self, records, limit, beyond):
        super().__init__({"uri": "", "limit": limit})
        self.given, self.beyond = [records[i : i + limit] for i in range(0, len(records), limit)], beyond

    def page(self, number):
        if number < len(self.given):
            return self.given[number]
        return [] if not self.given or self.beyond == "nothing" else self.given[-1]


@given(st.integers(0, 90), st.integers(1, 7), st.sampled_from(["nothing", "last"]), st.integers(1, 40))
def test_all_records_once(n, limit, beyond, size):
    source = Given([{"id": i + 1} for i in range(n)], limit, beyond)
    pages = source.pages_from(0)
    assert pages == -(-n // limit)
    got = [json.loads(r[3])["id"] for part in paging.ranges(0, pages * limit, size) for r in source.records(*part.value)]
    assert got == list(range(1, n + 1))
    # without a total that is right, the guard ends each range at the page that adds nothing
    assert {json.loads(r[3])["id"] for r in source.records(0, n + 1000)} == set(range(1, n + 1))


def test_page_that_is_ignored():
    class Same(Given):
        def page(self, number):
            return self.given[0]

    source = Same([{"id": 1}, {"name": "x"}], 2, "")
    assert source.pages_from(0) == 1 and len(list(source.records(0, 100))) == 2


def test_keys():
    assert [paging.key_of(r) for r in ({"item_id": 7, "id": 1}, {"item_id": 0, "id": 1}, {"b": 1, "a": "ё"}, 3)] == ["7", "1", '{"a": "ё", "b": 1}', "3"]


def landed(folder, pages):
    folder.mkdir(exist_ok=True)
    for n, rows in enumerate(pages):
        (folder / f"p{n}.json").write_text(json.dumps({"data": {"list": rows}}))
    return f"file://{folder}/p{{page}}.json"


def test_batch_of_files(spark, tmp_path):
    spark.dataSource.register(paging.Paged)
    uri = landed(tmp_path / "a", [[{"id": 1, "v": "a"}, {"id": 2}], [{"id": 2}, {"id": 3}], [{"id": 1, "v": "b"}]])
    df = spark.read.format("paged").options(uri=uri, rows="data.list", limit=2, per_partition=1).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 5
    got = sorted(paging.once(df).collect(), key=lambda r: r.key)
    assert [(r.page, r.position, r.key) for r in got] == [(0, 0, "1"), (0, 1, "2"), (1, 1, "3")] and json.loads(got[0].record)["v"] == "a"
    empty = spark.read.format("paged").options(uri=f"file://{tmp_path}/none{{page}}.json").load()
    assert empty.count() == 0


@pytest.fixture
def server():
    failed = set()

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            first = asked["params"]["offset"]
            if first == 4 and "once" not in failed:
                failed.add("once")
                self.send_response(503)
                self.end_headers()
                return
            rows = [{"item_id": i} for i in range(1, 12)][first : first + asked["params"]["limit"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"result": rows}).encode())

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/"
    made.shutdown()


def test_posted_pages_with_retries(spark, server):
    spark.dataSource.register(paging.Paged)
    body = '{"method": "get_items", "params": {"offset": «from», "limit": «limit»}}'
    df = spark.read.format("paged").options(uri=server, body=body, rows="result", limit=4, per_partition=1, pause=0.01).load()
    assert sorted(int(r.key) for r in df.collect()) == list(range(1, 12))


def test_stream_takes_what_has_come(spark, tmp_path):
    spark.dataSource.register(paging.Paged)
    rows = lambda a, b: [{"id": i} for i in range(a, b)]
    uri = landed(tmp_path / "s", [rows(1, 4), rows(4, 6)])

    def run():
        s = spark.readStream.format("paged").options(uri=uri, rows="data.list", limit=3).load()
        s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(int(r.key) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2, 3, 4, 5]
    landed(tmp_path / "s", [rows(1, 4), rows(4, 7), rows(7, 8)])
    assert run() == [1, 2, 3, 4, 5, 6, 7]
    assert run() == [1, 2, 3, 4, 5, 6, 7]
