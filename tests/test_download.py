import gzip
import http.server
import json
import threading

from causerie.__main__ import main
from causerie.sources.download import download


def test_download_skips_what_is_there_and_unpacks(tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        if url.endswith("/corpora/some"):
            return json.dumps({"plays": [{"name": "one"}, {"name": "two"}, {"name": "three"}]}).encode()
        return gzip.compress(b"<TEI>1</TEI>") if "/one/" in url else b"<TEI>3</TEI>"

    (tmp_path / "two.xml").write_text("old")
    assert list(download("http://x/api/", "some", str(tmp_path), fetch)) == ["one", "three"]
    assert (tmp_path / "one.xml").read_text() == "<TEI>1</TEI>" and (tmp_path / "two.xml").read_text() == "old" and (tmp_path / "three.xml").read_text() == "<TEI>3</TEI>"
    assert asked == ["http://x/api/corpora/some", "http://x/api/corpora/some/plays/one/tei", "http://x/api/corpora/some/plays/three/tei"]
    assert list(download("http://x/api", "some", str(tmp_path), fetch)) == []


def test_download_command_over_http(tmp_path, capsys):
    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"plays": [{"name": "one"}]}).encode() if self.path == "/api/corpora/some" else gzip.compress(b"<TEI/>"))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert main(["download", f"http://127.0.0.1:{server.server_port}/api", "some", str(tmp_path)]) == 0
    finally:
        server.shutdown()
        server.server_close()
    assert capsys.readouterr().out == "one\n" and (tmp_path / "one.xml").read_bytes() == b"<TEI/>"
