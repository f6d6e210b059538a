"""Container compose files: services, published ports, host paths, and how exposed they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import lits

#: Words of service names, first those that a network may need, then private ones; texts of suggestions; file names.
LAN_NAMES = ("homepage", "homarr", "dashy", "heimdall", "immich", "syncthing", "jellyfin", "plex", "navidrome", "nextcloud", "vaultwarden")
PRIVATE_NAMES = ("postgres", "postgresql", "mariadb", "mysql", "redis", "meili", "meilisearch", "qdrant", "ollama", "searx", "searxng", "adminer", "pgadmin", "n8n", "linkwarden", "worker", "db", "database", "machine_learning")
SUGGEST_LONG = "Review long syntax manually; set host_ip: 127.0.0.1 if private."
SUGGEST_NOTHING = "Already loopback-only."
SUGGEST_LAN = "May need LAN access. Keep exposed only if you actually use it from phone/LAN, or put behind Tailscale/reverse proxy."
SUGGEST_LOCAL = "Consider changing to: 127.0.0.1:"
SUGGEST_LAN_LONG = "May need LAN access. Keep exposed only if needed or place behind controlled entry point."
SUGGEST_LOCAL_LONG = "Consider long syntax host_ip: 127.0.0.1 for published port "
#: Keys of a long port.
PORT_KEYS = ("target", "published", "host_ip", "protocol")
COMPOSE_FILES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


def exposure(host_ip: Column) -> Column:
    h = F.lower(F.trim(host_ip))
    return F.when(h.isin("127.0.0.1", "localhost", "::1", "[::1]"), "LOOPBACK_ONLY").when(h.isin("", "0.0.0.0", "::", "[::]"), "LAN_EXPOSED").otherwise("SPECIFIC_INTERFACE")


def service_category(name: Column) -> Column:
    has = lambda words: F.exists(lits(words), lambda w: F.contains(F.lower(name), w))
    return F.when(has(LAN_NAMES), "probably LAN-needed").when(has(PRIVATE_NAMES), "probably private").otherwise("review manually")


def short_port(raw: Column) -> Column:
    """struct(host_ip, host_port, container_port, proto) of ip:host:container/proto; null for a container port alone."""
    plain = F.regexp_replace(F.trim(raw), "^[\"']|[\"']$", "")
    proto = F.when(F.contains(plain, F.lit("/")), F.regexp_extract(plain, "/([^/]*)$", 1)).otherwise("tcp")
    ports = F.trim(F.regexp_replace(plain, "/[^/]*$", ""))
    parts = F.split(ports, ":")
    n = F.size(parts)
    ip = F.when(n > 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ":")).otherwise("")
    good = (n > 1) & ~plain.rlike(r"^(target|published|host_ip|protocol)\s*:")
    return F.when(good, F.struct(ip.alias("host_ip"), F.get(parts, n - 2).alias("host_port"), F.get(parts, n - 1).alias("container_port"), proto.alias("proto")))


def volume(raw: Column) -> Column:
    """struct(host_path, target) of a mount of a path; null for a named volume."""
    plain = F.regexp_replace(F.trim(raw), "^[\"']|[\"']$", "")
    parts = F.split(plain, ":")
    return F.when((F.size(parts) > 1) & plain.rlike("^[/.~]"), F.struct(F.get(parts, F.lit(0)).alias("host_path"), F.get(parts, F.lit(1)).alias("target")))


def suggestion(port: Column, category: Column) -> Column:
    """What to do about a port that short_port() took apart."""
    tail = F.when(port.proto != "tcp", F.concat(F.lit("/"), port.proto)).otherwise("")
    local = F.concat(F.lit(SUGGEST_LOCAL), port.host_port, F.lit(":"), port.container_port, tail)
    return (
        F.when(port.isNull(), SUGGEST_LONG)
        .when(exposure(port.host_ip) == "LOOPBACK_ONLY", SUGGEST_NOTHING)
        .when(category == "probably LAN-needed", SUGGEST_LAN)
        .otherwise(local)
    )


def long_suggestion(port: Column, category: Column) -> Column:
    return F.when(exposure(port.host_ip) == "LOOPBACK_ONLY", SUGGEST_NOTHING).when(category == "probably LAN-needed", SUGGEST_LAN_LONG).otherwise(F.concat(F.lit(SUGGEST_LOCAL_LONG), port.host_port, F.lit(".")))


def container_exposure(ports: Column) -> Column:
    """Of a container's list of ports as text."""
    has = lambda *xs: F.exists(lits(xs), lambda x: F.contains(ports, x))
    return F.when(has("0.0.0.0:", ":::"), "LAN_EXPOSED").when(has("127.0.0.1:", "[::1]:"), "LOOPBACK_ONLY").when(ports != "", "REVIEW").otherwise("NO_PUBLISHED_PORTS")


def _uncomment(line: str) -> str:
    """A line without a comment; a # in quotes is no comment."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k]
    return line


#: A service's name alone on its line.
SERVICE = re.compile(r"([A-Za-z0-9_.-]+):")


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(number, indentation, what is there) of lines with more than a comment."""
    for n, full in enumerate(text.splitlines(), 1):
        line = _uncomment(full)
        if line.strip():
            yield n, len(line) - len(line.lstrip(" ")), line.strip()


class _Block:
    """Where a reader is: the depth of a services block and of the names in it, a service, and one of its lists."""

    def __init__(self) -> None:
        self.root = self.names = self.service = self.section = self.entry = None
        self.rows: list[dict] = []
        self.seen: set[str] = set()

    def add(self, kind: str, line: int, raw: str | None = None, long: dict | None = None) -> None:
        self.rows.append({"service": self.service, "kind": kind, "raw": raw, "line_no": line} | ({"long": long} if long else {}))

    def end_entry(self) -> None:
        """A long port counts if it has a target and something is published."""
        e, self.entry = self.entry, None
        if e and self.service and e.get("target") and e.get("published"):
            long = {"host_ip": e.get("host_ip", ""), "host_port": e["published"], "container_port": e["target"], "proto": e.get("protocol", "tcp")}
            self.add("port", e["line_no"], f"host_ip={long['host_ip'] or '*'} published={long['host_port']} target={long['container_port']}/{long['proto']}", long)

    def leave(self, service: str | None = None) -> None:
        self.end_entry()
        self.service, self.section = service, None

    def take(self, n: int, depth: int, bare: str) -> None:
        listed = bare.startswith("-")
        if bare == "services:":
            self.leave()
            self.root, self.names = depth, None
        elif self.root is None:
            return
        elif depth <= self.root and not listed:
            self.leave()
            self.root = None
        elif (name := SERVICE.fullmatch(bare)) and (self.names is None or depth <= self.names):
            self.leave(name[1])
            self.names = depth
            if name[1] not in self.seen:
                self.seen.add(name[1])
                self.add("service", n)
        elif self.service is not None:
            self.take_of_service(n, depth, bare, listed)

    def take_of_service(self, n: int, depth: int, bare: str, listed: bool) -> None:
        for section in ("ports", "volumes"):
            if bare.startswith(section + ":"):
                self.end_entry()
                self.section = section, depth
                return
        if self.section and depth <= self.section[1] and not listed:
            self.end_entry()
            self.section = None
        if not self.section:
            return
        kind = self.section[0][:-1]
        if bare.startswith("- "):
            self.end_entry()
            item = bare[2:].strip()
            if kind == "port" and item.startswith("target:"):
                self.entry = {"line_no": n}
                bare = item
            else:
                self.add(kind, n, item.strip("\"'"))
        key, colon, value = bare.partition(":")
        if self.entry is not None and colon and key.strip() in PORT_KEYS:
            self.entry[key.strip()] = value.strip().strip("\"'")


def read_compose(text: str) -> list[dict]:
    """Services, ports and mounts with line numbers, by indentation of any step. Services are named below a line
    ``services:`` at any depth, the least deep names first met being those of services; sections may be at any depth below
    them, and the entries of a list at that of its section or deeper. What stands outside such blocks, as names of volumes, counts for nothing."""
    block = _Block()
    for n, depth, bare in _lines(text):
        block.take(n, depth, bare)
    block.end_entry()
    return block.rows


def parse(files: DataFrame) -> DataFrame:
    """compose_file, service, kind (service, port or volume), raw, line_no and long (a port in long form) of files (path, text)."""

    def rows(batches):
        for b in batches:
            long = pa.struct([(c, pa.string()) for c in ("host_ip", "host_port", "container_port", "proto")])
            found = [{"compose_file": p} | x for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in read_compose(t or "")]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("compose_file", pa.string()), ("service", pa.string()), ("kind", pa.string()), ("raw", pa.string()), ("line_no", pa.int32()), ("long", long)]))

    return files.select("path", "text").mapInArrow(rows, "compose_file string, service string, kind string, raw string, line_no int, long struct<host_ip:string,host_port:string,container_port:string,proto:string>")


def ports(parsed: DataFrame) -> DataFrame:
    p = parsed.filter("kind = 'port'").withColumn("p", F.coalesce("long", short_port(F.col("raw")))).filter("p is not null").withColumn("category", service_category(F.col("service")))
    return p.select("compose_file", "service", "line_no", "raw", "p.*", exposure(F.col("p.host_ip")).alias("exposure"), "category", F.when(F.col("long").isNull(), suggestion(F.col("p"), F.col("category"))).otherwise(long_suggestion(F.col("p"), F.col("category"))).alias("suggestion"))


def volumes(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'volume'").withColumn("v", volume(F.col("raw"))).filter("v is not null").select("compose_file", "service", "line_no", "v.*")


def services_map(parsed: DataFrame) -> DataFrame:
    """Each service with its urls, exposures and data paths; those without ports too."""
    keys = ["compose_file", "service"]
    host = F.when(F.col("exposure") == "LOOPBACK_ONLY", "127.0.0.1").when(F.col("host_ip") == "", "LAN IP").otherwise(F.col("host_ip"))
    url = F.concat(F.lit("http://"), host, F.lit(":"), "host_port")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_no", c.alias("x")))), lambda s: s.x)
    p = ports(parsed).groupBy(*keys).agg(F.array_join(in_order(url), ", ").alias("urls"), F.array_join(F.array_sort(F.collect_set("exposure")), ", ").alias("exposure"))
    v = volumes(parsed).groupBy(*keys).agg(F.array_join(in_order(F.col("host_path")), "; ").alias("data"))
    every = parsed.select(*keys).distinct().join(p, keys, "left").join(v, keys, "left")
    return every.select(*keys, F.coalesce("urls", F.lit("-")).alias("urls"), F.coalesce("exposure", F.lit("NO_PUBLISHED_PORTS")).alias("exposure"), F.coalesce("data", F.lit("-")).alias("data"))


def summary(parsed: DataFrame) -> DataFrame:
    p = ports(parsed)
    exposed = F.col("exposure") == "LAN_EXPOSED"
    counts = p.agg(F.count("*").alias("ports"), F.count_if(exposed).alias("exposed"), F.count_if(exposed & (F.col("category") == "probably private")).alias("private_exposed"))
    services = parsed.agg(F.countDistinct("compose_file").alias("files"), F.count_if(F.col("kind") == "service").alias("services"))
    return services.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")


def candidates(parsed: DataFrame) -> DataFrame:
    """Exposed ports to look at: private services first, then those to review."""
    p = ports(parsed).filter("exposure = 'LAN_EXPOSED' and category <> 'probably LAN-needed'")
    first = F.when(F.col("category") == "probably private", "High").otherwise("Review")
    return p.select(first.alias("priority"), "service", "raw", "suggestion", "compose_file", "line_no").orderBy("priority", "compose_file", "line_no")
