"""Compiled rule artifacts: a fixed little-endian layout, read all or nothing.

A file is a header, sections of fixed-size records at offsets that are
multiples of 8, a string pool and a CRC-32C over all that precedes it. Writing
gives version 5; version 4, which has no witness section, is read as well.
Every reference is checked before a rule is made of it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..plans.model import NUMERIC, Kind, Network, Op, Predicate, Rule, RuleSet, Selection, Token, Witness

# The layout.
MAGIC, VERSION, OLD_VERSION = 0x53474D41, 5, 4
HEADER = struct.Struct("<2IQ32I")
OLD_HEADER_SIZE = 136
STRING, PREDICATE, SLICE = struct.Struct("<2I"), struct.Struct("<HHBB2xI4xq"), struct.Struct("<2I")
TOKEN, RULE, NETWORK = struct.Struct("<B3xI"), struct.Struct("<5IBBH2I"), struct.Struct("<BB2x16s")
INDEX, POSTING, WITNESS, COUNT = struct.Struct("<I"), struct.Struct("<IHBB"), struct.Struct("<IHBBq"), struct.Struct("<B")
#: Header slots after magic, version and size: (count slot or None, offset slot) of each section.
SLOTS = {
    "fields": (0, 1), "values": (2, 3), "preds": (4, 5), "sels": (6, 7), "cond": (8, 9), "rules": (10, 11),
    "pool": (12, 13), "cidrs": (14, 15), "bucket_names": (17, 18), "buckets": (17, 19), "bucket_members": (20, 21),
    "needles": (22, 23), "needle_slices": (22, 24), "postings": (25, 26), "always": (27, 28), "clauses": (None, 29),
    "witnesses": (30, 31),
}
RECORDS = {
    "fields": STRING, "values": STRING, "preds": PREDICATE, "sels": SLICE, "cond": TOKEN, "rules": RULE,
    "cidrs": NETWORK, "bucket_names": STRING, "buckets": SLICE, "bucket_members": INDEX, "needles": STRING, "needle_slices": SLICE,
    "postings": POSTING, "always": INDEX, "clauses": COUNT, "witnesses": WITNESS,
}
NO_VALUE, ANY_FIELD, MAX_CLAUSES = 0xFFFFFFFF, 0xFFFF, 32
CASED, NEGATED, FIELDREF = 1, 2, 4
CRC_POLYNOMIAL = 0x82F63B78


class ArtifactError(ValueError):
    """Why a file was refused: reason is magic, version, size, crc or range."""

    def __init__(self, reason: str, what: str = ""):
        super().__init__(f"{reason}: {what}" if what else reason)
        self.reason = reason


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CRC_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    return table


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


# --- reading -------------------------------------------------------------------


def _need(good: bool, what: str) -> None:
    if not good:
        raise ArtifactError("range", what)


class _Sections:
    """The records of each section, after the checks that concern whole sections."""

    def __init__(self, data: bytes):
        if len(data) < 12:
            raise ArtifactError("size")
        magic, version = struct.unpack_from("<2I", data)
        if magic != MAGIC:
            raise ArtifactError("magic")
        if version not in (OLD_VERSION, VERSION):
            raise ArtifactError("version", str(version))
        header_size = OLD_HEADER_SIZE if version == OLD_VERSION else HEADER.size
        if len(data) < header_size + 4:
            raise ArtifactError("size")
        head = HEADER.unpack(data[:header_size].ljust(HEADER.size, b"\0"))
        if head[2] != len(data):
            raise ArtifactError("size")
        slots = head[3:]
        for name, record in RECORDS.items():
            count_slot, offset_slot = SLOTS[name]
            offset = slots[offset_slot]
            if count_slot is None:
                count = slots[SLOTS["rules"][0]] if offset else 0
            else:
                count = slots[count_slot]
            _need(not count or offset % 8 == 0 and offset + count * record.size <= len(data), name)
            setattr(self, name, [record.unpack_from(data, offset + i * record.size) for i in range(count)])
        size, offset = slots[SLOTS["pool"][0]], slots[SLOTS["pool"][1]]
        _need(offset + size <= len(data), "string pool")
        if crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ArtifactError("crc")
        self.pool, self.has_clauses = data[offset : offset + size], bool(slots[SLOTS["clauses"][1]])

    def text(self, ref: tuple[int, int], what: str) -> str:
        _need(ref[0] + ref[1] <= len(self.pool), what)
        return self.pool[ref[0] : ref[0] + ref[1]].decode("utf-8", "replace")


def _slice(rows: list, start: int, count: int, what: str) -> list:
    _need(start + count <= len(rows), what)
    return rows[start : start + count]


def loads(data: bytes) -> RuleSet:
    """The rule set of an artifact's bytes, or ArtifactError."""
    s = _Sections(data)
    fields = []
    for offset, size in s.fields:
        _need(offset + size + 1 <= len(s.pool) and s.pool[offset + size] == 0, "field name")
        fields.append(s.text((offset, size), "field name"))
    values = [s.text(v, "value") for v in s.values]
    cidrs = [Network(6 if family == 6 else 4, prefix, net[: 16 if family == 6 else 4]) for family, prefix, net in s.cidrs]
    preds = [_predicate(p, fields, values, cidrs) for p in s.preds]
    sels = [_selection(_slice(preds, a, n, "selection")) for a, n in s.sels]
    for kind, _ in s.cond:
        _need(kind <= Kind.NOT, "condition token")
    tokens = [Token(Kind(kind), at) for kind, at in s.cond]

    def value(i: int, what: str) -> str | None:
        _need(i == NO_VALUE or i < len(values), what)
        return None if i == NO_VALUE else values[i]

    rules = []
    for rid, sel, n_sel, cond, n_cond, verdict, severity, score, name, mitre in s.rules:
        rules.append(
            Rule(
                rid, value(name, "title"), tuple(_slice(sels, sel, n_sel, "rule's selections")),
                tuple(_slice(tokens, cond, n_cond, "rule's condition")), verdict, severity, score, value(mitre, "label"),
            )
        )
    return RuleSet(tuple(rules), _buckets(s, len(rules)), *_conditions(s, fields, cidrs, len(rules)))


def _predicate(row, fields, values, cidrs) -> tuple[int, Predicate]:
    field, group, op, flags, value, number = row
    _need(field < len(fields), "predicate's field")
    operand: str | int | Network | None
    if flags & FIELDREF:
        _need(value < len(fields), "referenced field")
        operand = fields[value]
    elif op == Op.CIDR:
        _need(value < len(cidrs), "network")
        operand = cidrs[value]
    else:
        _need(value == NO_VALUE or value < len(values), "operand")
        operand = number if op in NUMERIC else (None if value == NO_VALUE else values[value])
    try:
        code = Op(op)
    except ValueError:
        code = op  # an unknown operator never matches
    return group, Predicate(
        fields[field], code, operand, bool(flags & CASED), bool(flags & NEGATED), bool(flags & FIELDREF)
    )


def _selection(rows) -> Selection:
    groups: list[list[Predicate]] = []
    last = None
    for group, p in rows:
        if group != last:
            groups.append([])
        groups[-1].append(p)
        last = group
    return Selection(tuple(map(tuple, groups)))


def _buckets(s: _Sections, n_rules: int) -> dict[str, tuple[int, ...]]:
    for (i,) in s.bucket_members:
        _need(i < n_rules, "bucket entry")
    out: dict[str, tuple[int, ...]] = {}
    for key, (start, count) in zip(s.bucket_names, s.buckets, strict=True):
        name = s.text(key, "bucket key")
        own = tuple(i for (i,) in _slice(s.bucket_members, start, count, "bucket"))
        _need(name != "" or "" not in out, "a second always-verify bucket")
        out[name] = out.get(name, own)  # of equal keys the first is found
    return out


def _conditions(s: _Sections, fields, cidrs, n_rules: int):
    clauses = tuple(c for (c,) in s.clauses)
    for c in clauses:
        _need(c <= MAX_CLAUSES, "clause count")

    def check(rule: int, clause: int, what: str) -> None:
        _need(rule < n_rules and clause < MAX_CLAUSES and bool(clauses) and clause < clauses[rule], what)

    for rule, field, clause, _ in s.postings:
        _need(field == ANY_FIELD or field < len(fields), "posting's field")
        check(rule, clause, "posting")
    found = []
    for needle, (start, count) in zip(s.needles, s.needle_slices, strict=True):
        literal = s.text(needle, "needle")
        _need(needle[1] > 0, "empty needle")
        for rule, field, clause, _ in _slice(s.postings, start, count, "postings"):
            found.append(Witness(rule, clause, None if field == ANY_FIELD else fields[field], literal))
    always = tuple(i for (i,) in s.always)
    for i in always:
        _need(i < n_rules and not (clauses and clauses[i]), "always-verify entry")
    for rule, field, clause, op, number in s.witnesses:
        _need(field != ANY_FIELD and field < len(fields), "witness's field")
        check(rule, clause, "witness")
        _need(op == Op.CIDR or op in NUMERIC, "witness's operator")
        if op == Op.CIDR:
            _need(0 <= number < len(cidrs), "witness's network")
        found.append(Witness(rule, clause, fields[field], None, Op(op), cidrs[number] if op == Op.CIDR else number))
    return tuple(found), clauses, always


def load(path: str) -> RuleSet:
    with open(path, "rb") as f:
        return loads(f.read())


def load_with_spark(spark, path: str) -> RuleSet:
    """From any path that Spark reads."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return loads(bytes(row[0]))


def shared_path(spark, name: str) -> str:
    """A new path that all executors read: in the checkpoint folder or the warehouse."""
    import uuid

    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    return f"{folder or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4()}.bin"


def _file_system(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bytes(spark, data: bytes, path: str) -> None:
    """To any path that Spark writes."""
    where, system = _file_system(spark, path)
    out = system.create(where)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def dump_with_spark(spark, rules: RuleSet, path: str) -> None:
    write_bytes(spark, dumps(rules), path)


def remove(spark, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, False)


# --- writing -------------------------------------------------------------------


class _Pool:
    """Interned strings: each string once, field names with a terminator."""

    def __init__(self):
        self.data, self.at = bytearray(), {}

    def ref(self, text: str, terminated: bool = False) -> tuple[int, int]:
        raw = text.encode()
        key = (raw, terminated)
        if key not in self.at:
            self.at[key] = len(self.data)
            self.data += raw + b"\0" * terminated
        return self.at[key], len(raw)


class _Index(dict):
    """value -> position in order of first use."""

    def of(self, value) -> int:
        return self.setdefault(value, len(self))


def dumps(rules: RuleSet) -> bytes:
    """The version 5 artifact of a rule set."""
    fields, values, cidrs = _Index(), _Index(), _Index()
    rows: dict[str, list[tuple]] = {name: [] for name in RECORDS}
    for r in rules.rules:
        first_sel, first_tok = len(rows["sels"]), len(rows["cond"])
        for s in r.selections:
            start = len(rows["preds"])
            for group, predicates in enumerate(s.groups):
                for p in predicates:
                    rows["preds"].append(_predicate_row(p, group, fields, values, cidrs))
            rows["sels"].append((start, len(rows["preds"]) - start))
        rows["cond"] += [(int(t.kind), t.index) for t in r.condition]
        name, mitre = (NO_VALUE if x is None else values.of(x) for x in (r.name, r.mitre))
        rows["rules"].append(
            (r.rule_id, first_sel, len(r.selections), first_tok, len(r.condition), int(r.verdict), r.severity, r.score_x100, name, mitre)
        )
    pool = _Pool()
    needles: dict[str, list[tuple]] = {}
    for w in rules.witnesses:
        field = ANY_FIELD if w.field is None else fields.of(w.field)
        if w.literal is not None:
            needles.setdefault(w.literal, []).append((w.rule, field, w.clause, 0))
        else:
            number = cidrs.of(w.value) if w.op == Op.CIDR else w.value
            rows["witnesses"].append((w.rule, field, w.clause, int(w.op), number))
    for literal, postings in needles.items():
        rows["needles"].append(pool.ref(literal))
        rows["needle_slices"].append((len(rows["postings"]), len(postings)))
        rows["postings"] += postings
    for key, members in rules.buckets.items():
        rows["bucket_names"].append(pool.ref(key))
        rows["buckets"].append((len(rows["bucket_members"]), len(members)))
        rows["bucket_members"] += [(i,) for i in members]
    rows["always"] = [(i,) for i in rules.always]
    rows["clauses"] = [(c,) for c in rules.clauses]
    rows["fields"] = [pool.ref(f, terminated=True) for f in fields]
    rows["values"] = [pool.ref(v) for v in values]
    rows["cidrs"] = [(n.version, n.prefix, n.address.ljust(16, b"\0")) for n in cidrs]
    return _assemble(rows, bytes(pool.data))


def _predicate_row(p: Predicate, group: int, fields: _Index, values: _Index, cidrs: _Index) -> tuple:
    flags = CASED * p.cased | NEGATED * p.negate | FIELDREF * p.fieldref
    value, number = NO_VALUE, 0
    if p.fieldref:
        value = fields.of(p.value)
    elif p.op == Op.CIDR:
        value = cidrs.of(p.value)
    elif p.op in NUMERIC:
        number = p.value
    elif p.value is not None:
        value = values.of(p.value)
    return fields.of(p.field), group, int(p.op), flags, value, number


def _assemble(rows: dict[str, list[tuple]], pool: bytes) -> bytes:
    body = bytearray(HEADER.size)
    slots = [0] * 32
    order = [n for n in RECORDS]
    for name in order:
        count_slot, offset_slot = SLOTS[name]
        if rows[name]:
            body += b"\0" * (-len(body) % 8)
            slots[offset_slot] = len(body)
            body += b"".join(RECORDS[name].pack(*row) for row in rows[name])
        if count_slot is not None:
            slots[count_slot] = len(rows[name])
    body += b"\0" * (-len(body) % 8)
    slots[SLOTS["pool"][0]], slots[SLOTS["pool"][1]] = len(pool), len(body)
    body += pool
    HEADER.pack_into(body, 0, MAGIC, VERSION, len(body) + 4, *slots)
    return bytes(body) + struct.pack("<I", crc32c(bytes(body)))


def dump(rules: RuleSet, path: str) -> None:
    with open(path, "wb") as f:
        f.write(dumps(rules))


# --- tables --------------------------------------------------------------------

RULE_COLUMNS = (
    "position int, rule_id long, name string, verdict string, severity int, score decimal(5,2), mitre string, "
    "n_selections int, n_predicates int, fields array<string>, buckets array<string>"
)


def catalogue(rules: RuleSet) -> Iterator[tuple]:
    """A row for each rule, as RULE_COLUMNS names them."""
    from decimal import Decimal

    from ..plans.model import Verdict

    names = {int(v): v.name.lower() for v in Verdict}
    for i, r in enumerate(rules.rules):
        yield (
            i, r.rule_id, r.name, names.get(int(r.verdict)), r.severity, Decimal(r.score_x100).scaleb(-2), r.mitre,
            len(r.selections), sum(1 for _ in r.predicates()), sorted(r.fields()),
            [k for k, members in rules.buckets.items() if i in members],
        )


def rule_table(spark, rules: RuleSet):
    """The rule catalogue as a DataFrame."""
    return spark.createDataFrame(list(catalogue(rules)), RULE_COLUMNS)


def register(spark) -> None:
    """Makes spark.read.format("ruleset").load(path) give the rule catalogue."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, path):
            self.path = path

        def read(self, partition):
            yield from catalogue(load(self.path))

    class Rules(DataSource):
        @classmethod
        def name(cls):
            return "ruleset"

        def schema(self):
            return RULE_COLUMNS

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Rules)
