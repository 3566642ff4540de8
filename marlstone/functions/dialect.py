"""SQL fragments that differ between Spark SQL and the SQL of the oracle engine.

A plan is written once as a function of a dialect; ``sql_query`` registers its Spark form as the query
and its other form as the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from marlstone.registry import query
from marlstone.sources.tables import TABLES, table


class Dialect:
    """Fragments for one engine; ``spark`` tells which."""

    def __init__(self, spark: bool):
        self.spark = spark

    def like(self, a: str, p: str) -> str:
        return f"({a} rlike '{p}')" if self.spark else f"regexp_matches({a}, '{p}')"

    def sub(self, a: str, p: str, r: str) -> str:
        return f"regexp_replace({a}, '{p}', '{r}')" if self.spark else "regexp_replace({}, '{}', '{}', 'g')".format(a, p, re.sub(r"\$(\d)", r"\\\1", r))

    def get(self, a: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({a}, '{p}', {g})"

    def all(self, a: str, p: str) -> str:
        return f"regexp_extract_all({a}, '{p}', 0)" if self.spark else f"regexp_extract_all({a}, '{p}')"

    def words(self, a: str) -> str:
        return self.all(f"coalesce({a}, '')", "[^ \t\n\r]+")

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)" if self.spark else f"len({a})::bigint"

    def at(self, a: str, i: str) -> str:
        """1-based element; null outside."""
        return f"try_element_at({a}, cast({i} as int))" if self.spark else f"{a}[({i})::bigint]"

    def explode(self, source: str, array: str, keep: str, at: str, value: str) -> str:
        """Rows (keep, at from 0, value) for each element of ``array``."""
        if self.spark:
            return f"(select {keep}, cast({at} as bigint) as {at}, {value} from {source} lateral view posexplode({array}) as {at}, {value})"
        return f"(select {keep}, unnest(range(0, len({array}))) as {at}, unnest({array}) as {value} from {source})"

    def epoch_us(self, a: str) -> str:
        return f"unix_micros(cast({a} as timestamp))" if self.spark else f"epoch_us({a})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def day(self, a: str) -> str:
        """Days since 1970-01-01."""
        return f"cast(datediff(cast({a} as date), date'1970-01-01') as bigint)" if self.spark else f"date_diff('day', date '1970-01-01', cast({a} as date))::bigint"

    def sorted_list(self, a: str) -> str:
        return f"array_sort(collect_list({a}))" if self.spark else f"list_sort(list({a}))"

    def hash(self, a: str) -> str:
        """A positive 60-bit number from SHA-256, equal in both engines."""
        return f"cast(conv(substr(sha2({a}, 256), 1, 15), 16, 10) as bigint)" if self.spark else f"('0x' || substr(sha256({a}), 1, 15))::bigint"

    def sha(self, a: str) -> str:
        return f"sha2({a}, 256)" if self.spark else f"sha256({a})"

    def json(self, a: str, path: str) -> str:
        return f"get_json_object({a}, '$.{path}')" if self.spark else f"json_extract_string({a}, '$.{path}')"

    def quote(self, n: int, alias: str, columns: str) -> str:
        """The numbers 0..n-1 as a table."""
        return f"(select cast(id as bigint) as {columns} from range(0, {n})) {alias}" if self.spark else f"(select range as {columns} from range(0, {n})) {alias}"

    def numbers(self, low: str, high: str) -> str:
        """The list low..high, both included; empty if high < low."""
        if self.spark:
            return f"case when ({high}) >= ({low}) then sequence(cast({low} as bigint), cast({high} as bigint)) else cast(array() as array<bigint>) end"
        return f"range(({low})::bigint, ({high})::bigint + 1)"

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))" if self.spark else f"xor({a}, {b})"

    def shl(self, a: str, n: str) -> str:
        return f"shiftleft({a}, {n})" if self.spark else f"(({a}) << ({n}))"

    def shr(self, a: str, n: str) -> str:
        return f"shiftright({a}, cast({n} as int))" if self.spark else f"(({a}) >> ({n}))"

    def split(self, a: str, sep: str) -> str:
        return f"split({a}, '{sep}')" if self.spark else f"string_split({a}, '{sep}')"

    @property
    def logits(self) -> str:
        """Embedding entries as (row_id, token_id, logit)."""
        return "(select row_id, token_id, cast(x as double) as logit from " + self.explode("embeddings", "embedding", "vec_id as row_id", "token_id", "x") + " e)"

    @property
    def doc_words(self) -> str:
        """Words of documents as (doc_id, source, lang, pos, word)."""
        return self.explode(f"(select doc_id, source, lang, {self.words('text')} as w from documents) dw", "w", "doc_id, source, lang", "pos", "word")

    @property
    def doc_lines(self) -> str:
        """Lines of documents as (doc_id, source, pos, line)."""
        return self.explode(f"(select doc_id, source, {self.split('text', chr(10))} as l from documents) dl", "l", "doc_id, source", "pos", "line")

    @property
    def requests(self) -> str:
        return "(select event_id as request_id, event_type as outcome, value as duration_ms, ts, user_id from events)"

    def shingles(self, table: str, key: str, n: int, unit: str = "word") -> str:
        """Distinct n-word shingles as (key, shingle)."""
        w = self.words("text")
        make = (f"concat_ws(' ', slice(w, cast(i as int), {n}))" if self.spark else f"array_to_string(w[i:i + {n - 1}], ' ')")
        rows = f"(select {key}, w, {self.numbers('1', self.size('w') + f' - {n - 1}')} as places from (select {key}, {w} as w from {table}) sw)"
        if self.spark:
            return f"(select distinct {key}, {make} as shingle from {rows} lateral view explode(places) as i)"
        return f"(select distinct {key}, {make} as shingle from (select {key}, w, unnest(places) as i from {rows}))"


SPARK, DUCK = Dialect(True), Dialect(False)
_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def run_sql(spark, sf_dir: str, text: str):
    """Run Spark SQL over the tables it names."""
    for name in sorted(set(_NAMES.findall(text))):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def sql_query(name: str, longs: str = "") -> Callable:
    """Register a plan written as a function of a dialect; ``longs`` names columns to widen to long."""

    def add(f: Callable[[Dialect], str]):
        text = f(SPARK)

        def run(spark, sf_dir: str):
            df = run_sql(spark, sf_dir, text)
            return df.withColumns({c: df[c].cast("long") for c in longs.split()}) if longs else df

        run.__name__, run.__doc__ = name, f.__doc__
        query(name, f(DUCK))(run)
        return f

    return add
