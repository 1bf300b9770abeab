"""Lines from TCP and datagrams from UDP as streams, and an echo of them.

The reference's only unbounded inputs are socket servers; these are their streaming forms. Sockets can't be replayed: both
are for trying things out, and what is in flight when a reader fails is lost. Datagrams wait on the driver, KEPT at most.
"""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MOST_BYTES, KEPT = 65_507, 100_000


def tcp_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """``value``, a row for each line that a server sends."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


class Received(InputPartition):
    def __init__(self, rows: list[tuple[str, bytes]]) -> None:
        self.rows = rows


class Datagrams(DataSourceStreamReader):
    """Listens on a port beside the driver; a batch has what has come since the last, and its task gets the data themselves."""

    def __init__(self, host: str, port: int, echo: bool) -> None:
        self.at, self.echo, self.held, self.first, self.lock, self.socket, self.error = (host, port), echo, [], 0, None, None, None

    def start(self) -> None:
        """Opens the port with the first batch: Spark makes readers that it only asks for their schema."""
        if self.socket is None:
            # numbers go on from the clock, so that those of a query that starts again lie above the ones that it knows
            self.first, self.lock = int(time.time() * 1e6), threading.Lock()
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.at)
            threading.Thread(target=self.listen, daemon=True).start()
        if self.error is not None:
            raise RuntimeError(self.error)

    def listen(self) -> None:
        while True:
            try:
                data, sender = self.socket.recvfrom(MOST_BYTES)
            except OSError as e:
                self.error = f"the port can't be read any more: {e}"
                return
            if self.echo:
                self.socket.sendto(data, sender)
            with self.lock:
                if len(self.held) == KEPT:  # the query fails with its next batch, rather than lose some unsaid
                    self.error = f"more than {KEPT} datagrams wait for the query"
                    return
                self.held.append((f"{sender[0]}:{sender[1]}", bytes(data)))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        self.start()
        with self.lock:
            return {"next": self.first + len(self.held)}

    def partitions(self, start: dict, end: dict) -> list[Received]:
        self.start()
        with self.lock:
            return [Received(self.held[max(0, start["next"] - self.first) : max(0, end["next"] - self.first)])]

    def read(self, partition: Received) -> Iterator[tuple]:
        return iter(partition.rows)

    def commit(self, end: dict) -> None:
        self.start()
        with self.lock:
            if end["next"] > self.first:  # not a batch of a query that has been started again
                del self.held[: end["next"] - self.first]
                self.first = end["next"]


class UdpSource(DataSource):
    """``format("quarry_udp")``, options host, port and echo; columns sender and data."""

    @classmethod
    def name(cls) -> str:
        return "quarry_udp"

    def schema(self) -> str:
        return "sender string, data binary"

    def streamReader(self, schema: StructType) -> Datagrams:
        return Datagrams(self.options.get("host", "127.0.0.1"), int(self.options["port"]), self.options.get("echo", "true").lower() == "true")


def udp(spark: SparkSession, port: int, host: str = "127.0.0.1", echo: bool = True) -> DataFrame:
    spark.dataSource.register(UdpSource)
    return spark.readStream.format("quarry_udp").options(host=host, port=port, echo=str(echo).lower()).load()


def to_memory(stream: DataFrame, name: str) -> StreamingQuery:
    return stream.writeStream.format("memory").queryName(name).outputMode("append").start()


def send_datagrams(address: tuple[str, int], messages: Iterable[bytes], seconds: float = 2.0) -> list[bytes | None]:
    """Sends datagrams one by one and gives the answer to each, null where none comes in time (SRC-20)."""
    out: list[bytes | None] = []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.settimeout(seconds)
        for m in messages:
            s.sendto(m, address)
            try:
                out.append(s.recvfrom(MOST_BYTES)[0])
            except TimeoutError:
                out.append(None)
    return out


def send_lines(address: tuple[str, int], lines: Iterable[str], seconds: float = 10.0) -> int:
    """Sends lines to a TCP server; the number of bytes sent (SRC-20)."""
    sent = 0
    with socket.create_connection(address, seconds) as s:
        for line in lines:
            data = line.encode() + b"\n"
            s.sendall(data)
            sent += len(data)
    return sent
