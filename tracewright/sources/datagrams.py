"""Datagrams as a stream: each packet of a UDP port is a line, as event recorders send them."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Bytes of the largest packet.
PACKET = 65_535


class DatagramReader(SimpleDataSourceStreamReader):
    """Takes what has arrived at a port since the last micro-batch.

    Packets are gone once they are read, so only those of the running query
    can be given again; the stream's sink is what makes them last.
    """

    def __init__(self, options: dict[str, str]):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options["port"])
        self.most = int(options.get("maxPackets", 100_000))
        self.socket: socket.socket | None = None
        self.taken: dict[int, str] = {}

    def initialOffset(self) -> dict:
        return {"packets": 0}

    def _open(self) -> socket.socket:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind((self.host, self.port))
            self.socket.setblocking(False)
        return self.socket

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        port, at, lines = self._open(), start["packets"], []
        while len(lines) < self.most:
            try:
                packet = port.recv(PACKET)
            except BlockingIOError:
                break
            lines.append(packet.decode("utf-8", "replace").rstrip("\r\n"))
        self.taken.update(enumerate(lines, at))
        return iter([(x,) for x in lines]), {"packets": at + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(self.taken[i],) for i in range(start["packets"], end["packets"]) if i in self.taken])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.taken if i < end["packets"]]:
            del self.taken[i]


class Datagrams(DataSource):
    """``spark.readStream.format("datagrams")`` with the options port, host and maxPackets (of one micro-batch); column value."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> DatagramReader:
        return DatagramReader(self.options)


def register(spark) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Datagrams)
