"""A plain dictionary of keys: what commands mean, written once more and simply, to hold replays against."""

import fnmatch
import re

INT = re.compile(rb"[+-]?\d+\Z")
NOT_INT = "ERR value is not an integer or out of range"


class Store:
    def __init__(self):
        self.rows: dict[bytes, list] = {}  # value, deadline

    def sweep(self, now):
        for k in [k for k, (_, d) in self.rows.items() if d is not None and d <= now]:
            del self.rows[k]

    @staticmethod
    def canon(v):
        return str(int(v)).encode() if len(v) <= 20 and INT.match(v) and -(2**63) <= int(v) < 2**63 else v

    def run(self, now, name, args):
        self.sweep(now)
        a = list(args)
        d = self.rows
        row = d.get(a[0]) if a else None
        if name == "GET":
            return row[0] if row else None
        if name == "SET":
            d[a[0]] = [self.canon(a[1]), row[1] if row else None]
            return "OK"
        if name == "SETNX":
            if row:
                return 0
            d[a[0]] = [self.canon(a[1]), None]
            return 1
        if name == "SETEX":
            d[a[0]] = [self.canon(a[2]), now + int(a[1]) * 10**9]
            return "OK"
        if name == "GETDEL":
            return d.pop(a[0])[0] if row else None
        if name == "APPEND":
            d[a[0]] = [(row[0] if row else b"") + a[1], row[1] if row else None]
            return len(d[a[0]][0])
        if name == "INCRBY":
            if row and not (INT.match(row[0]) and -(2**63) <= int(row[0]) < 2**63):
                return NOT_INT
            n = (int(row[0]) if row else 0) + int(a[1])
            if not -(2**63) <= n < 2**63:
                return "ERR increment or decrement would overflow"
            d[a[0]] = [str(n).encode(), row[1] if row else None]
            return n
        if name == "EXPIRE":
            if int(a[1]) <= 0:
                return int(d.pop(a[0], None) is not None)
            if not row:
                return 0
            row[1] = now + int(a[1]) * 10**9
            return 1
        if name == "PERSIST":
            had = bool(row and row[1] is not None)
            if row:
                row[1] = None
            return int(had)
        if name == "TTL":
            return -2 if not row else -1 if row[1] is None else (row[1] - now) // 10**9
        if name == "DEL":
            return sum(d.pop(k, None) is not None for k in a)
        if name == "EXISTS":
            return sum(k in d for k in a)
        if name == "MGET":
            return [d[k][0] if k in d else None for k in a]
        if name == "MSET":
            for k, v in zip(a[::2], a[1::2], strict=True):
                d[k] = [self.canon(v), d[k][1] if k in d else None]
            return "OK"
        if name == "RENAME":
            if not row:
                return "ERR no such key"
            if a[0] != a[1]:
                d[a[1]] = d.pop(a[0])
            return "OK"
        if name == "COPY":
            if not row or a[1] in d:
                return 0
            d[a[1]] = list(row)
            return 1
        if name == "DBSIZE":
            return len(d)
        if name == "KEYS":
            return sorted(k for k in d if fnmatch.fnmatchcase(k.decode(), a[0].decode()))
        if name == "FLUSHDB":
            d.clear()
            return "OK"
        raise AssertionError(name)
