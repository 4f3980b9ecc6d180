"""The admin socket: a line in, a line out, over a local socket."""

from __future__ import annotations

import os
import socketserver
import threading

from keystrata.plans.service import Service


class AdminSocket:
    """Answers `reload <table>` with ok or err while it is open."""

    def __init__(self, service: Service, path: str) -> None:
        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for raw in self.rfile:
                    line = raw.decode("utf-8", "replace").strip()
                    if line:
                        self.wfile.write((service.admin(line) + "\n").encode())

        if os.path.exists(path):
            os.unlink(path)
        self.path = path
        self._server = socketserver.ThreadingUnixStreamServer(path, Handler)
        self._server.daemon_threads = True
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)

    def __enter__(self) -> AdminSocket:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._server.shutdown()
        self._server.server_close()
        os.unlink(self.path)
