"""Extraction over the driver's tables: each row of ``part`` becomes a source file of each language, and its facts are told.

The tables hold no source code, so files are written from templates with the row's name, brand and size.
What a template's facts are is stated beside it (see SURVEY, E0 to E20), and the SQL fills the same places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan

#: Languages whose SQL has all references; that of the others has those with an underscore in their name.
ALL_REFS = ("go", "tsx")
COLUMNS = ("path", "kind", "name", "owner", "detail", "start_line", "end_line")
FILES_IN_A_TASK = 20_000
_PLACES = {"{n}": "replace(p_name, ' ', '_')", "{b}": "replace(p_brand, '#', '_')", "{s}": "CAST(p_size AS VARCHAR(20))"}


def files(spark: SparkSession, sf_dir: str, language: str, text: str) -> DataFrame:
    """A file for each part, in the shape that the extractor takes."""
    content = F.lit(text)
    for place, value in _PLACES.items():
        content = F.replace(content, F.lit(place), F.expr(value))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size")
    part = part.repartition(max(spark.sparkContext.defaultParallelism, -(-part.count() // FILES_IN_A_TASK)))  # rows are short: one part of the table makes very many files
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(f".{scan.EXTENSIONS[language][0]}"))
    return part.select(
        path.alias("path"), F.lit(language).alias("language"), F.lit(0).cast("long").alias("mtime_nanos"),
        F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content.cast("binary"), 256).alias("content_hash"), content.cast("binary").alias("content"),
    )


def told(snaps: DataFrame, all_refs: bool = True) -> DataFrame:
    """All facts of snapshots (:func:`scan.extract`) in one shape (:data:`COLUMNS`), each fact of a file once.

    A file's facts are in its row, so nothing is joined, dealt out or kept: each file is read once. A file that
    could not be read has a row of the kind ``error``. ``all_refs`` unset: references with an underscore in their name.
    """
    nothing = F.lit(None).cast("string")
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    around = lambda x: F.concat(F.coalesce(F.concat(x["caller_class_name"], F.lit(".")), F.lit("")), F.coalesce(x["caller"], F.lit("-")))

    def params(x: F.Column) -> F.Column:
        ordered = F.array_sort(F.transform(x["params"], lambda p: F.struct(p["position"], p["name"], p["param_type"])))
        return F.array_join(F.transform(ordered, lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["param_type"], F.lit("")))), ",")

    def of(table: str, kind: str, name: str, owner: Callable[[F.Column], F.Column], detail: Callable[[F.Column], F.Column], lines: bool = True) -> F.Column:
        rows = scan.facts_of(table)
        rows = F.filter(rows, lambda x: F.contains(x["name"], F.lit("_"))) if table == "refs" and not all_refs else rows
        at = lambda x, c: x[c] if lines else F.lit(0)
        return F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x[name].alias("name"), owner(x).alias("owner"), detail(x).alias("detail"), *[at(x, c).cast("long").alias(c) for c in COLUMNS[5:]]))

    facts = F.concat(
        of("functions", "function", "name", lambda x: x["class_name"], lambda x: F.coalesce(params(x), F.lit(""))),
        of("classes", "class", "name", lambda x: x["kind"], lambda x: F.concat(F.coalesce(listed(x["methods"]), F.lit("")), F.lit("|"), F.coalesce(listed(x["super_classes"]), F.lit("")))),
        of("fields", "field", "name", lambda x: x["class_name"], lambda x: x["field_type"]),
        of("calls", "call", "callee", around, lambda x: x["object_name"]),
        of("imports", "import", "module", lambda _: nothing, lambda _: nothing),
        of("annotations", "annotation", "name", lambda x: F.concat(x["target_type"], F.lit(" "), x["target_name"]), lambda x: x["target_signature"]),
        of("python_properties", "property", "property_name", lambda x: x["class_name"], lambda _: nothing, lines=False),
        of("python_property_callers", "read", "property_name", around, lambda x: x["object_name"]),
        of("refs", "ref", "name", lambda x: x["node_type"], lambda _: nothing),
    )
    broken = F.array(F.struct(F.lit("error").alias("kind"), F.col("error").alias("name"), nothing.alias("owner"), nothing.alias("detail"), *[F.lit(0).cast("long").alias(c) for c in COLUMNS[5:]]))
    facts = F.when(F.col("error").isNull(), F.array_distinct(facts)).otherwise(broken)
    return snaps.select("path", F.explode(facts).alias("x")).select("path", *[f"x.{c}" for c in COLUMNS[1:]])


def _query(language: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: told(scan.extract(files(spark, sf_dir, language, SOURCES[language][0])), language in ALL_REFS)


def _sql(language: str) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = ",\n".join("(" + ", ".join(map(quoted, row)) + ")" for row in SOURCES[language][1])
    filled = lambda c: f"replace(replace(replace(e.{c}, '{{n}}', p.n), '{{b}}', p.b), '{{s}}', p.s) AS {c}"
    return f"""WITH p AS (SELECT 'p' || p_partkey || '.{scan.EXTENSIONS[language][0]}' AS path, {', '.join(f"{v} AS {k[1]}" for k, v in _PLACES.items())} FROM part),
e(kind, name, owner, detail, start_line, end_line) AS (VALUES {rows})
SELECT p.path, e.kind, {', '.join(map(filled, ('name', 'owner', 'detail')))}, CAST(e.start_line AS BIGINT) AS start_line, CAST(e.end_line AS BIGINT) AS end_line FROM p, e"""


#: Templates, and their facts: kind, name, owner, detail, first and last line.
SOURCES: dict[str, tuple[str, tuple[tuple, ...]]] = {
    "python": ('''import os.path
from .pkg{s} import helper_{s}


class Base:
    limit: int = {s}

    @property
    def {n}(self):
        return self.limit


class {b}(Base, mixins.Extra):
    def __init__(self, name: str, *rest):
        self.name = name
        self.size: int = {s}

    @cached(ttl={s})
    def run_{n}(self, n: int = 2, **kw):
        helper_{s}(n)
        return self.{n}

    def again(self):
        super().run_{n}(1)
        return os.path.join(self.name, str(self.size))


def main_{n}(a, b=None):
    {b}("x").run_{n}(a)
''', (
        ('annotation', 'property', 'method {n}', '@property\ndef {n}(self):', 8, 8),
        ('annotation', 'cached', 'method run_{n}', '@cached(ttl={s})\ndef run_{n}(self, n: int = 2, **kw):', 18, 18),
        ('call', 'cached', '{b}.-', None, 18, 18),
        ('call', 'helper_{s}', '{b}.run_{n}', None, 20, 20),
        ('call', 'run_{n}', '{b}.again', 'super()', 24, 24),
        ('call', 'join', '{b}.again', 'os.path', 25, 25),
        ('call', 'str', '{b}.again', None, 25, 25),
        ('call', '{b}', 'main_{n}', None, 29, 29),
        ('call', 'run_{n}', 'main_{n}', '{b}("x")', 29, 29),
        ('class', 'Base', 'class', '{n}|', 5, 10),
        ('class', '{b}', 'class', '__init__,again,run_{n}|Base,mixins.Extra', 13, 25),
        ('field', 'limit', 'Base', 'int', 6, 6),
        ('field', 'name', '{b}', None, 15, 15),
        ('field', 'size', '{b}', 'int', 16, 16),
        ('function', '{n}', 'Base', 'self:', 9, 10),
        ('function', '__init__', '{b}', 'self:,name:str,rest:', 14, 16),
        ('function', 'run_{n}', '{b}', 'self:,n:int,kw:', 19, 21),
        ('function', 'again', '{b}', 'self:', 23, 25),
        ('function', 'main_{n}', None, 'a:,b:', 28, 29),
        ('import', 'os.path', None, None, 1, 1),
        ('import', '.pkg{s}', None, None, 2, 2),
        ('property', '{n}', 'Base', None, 0, 0),
        ('read', '{n}', '{b}.run_{n}', 'self', 21, 21),
        ('ref', '{n}', 'identifier', None, 9, 9),
        ('ref', '{b}', 'identifier', None, 13, 13),
        ('ref', '__init__', 'identifier', None, 14, 14),
        ('ref', 'run_{n}', 'identifier', None, 19, 19),
        ('ref', 'helper_{s}', 'identifier', None, 20, 20),
        ('ref', '{n}', 'identifier', None, 21, 21),
        ('ref', 'run_{n}', 'identifier', None, 24, 24),
        ('ref', 'main_{n}', 'identifier', None, 28, 28),
        ('ref', '{b}', 'identifier', None, 29, 29),
        ('ref', 'run_{n}', 'identifier', None, 29, 29),
        ('ref', 'helper_{s}', 'dotted_name', None, 2, 2),
    )),
    "java": ('''package shop;

import java.util.List;
import static java.lang.Math.*;

@Entity
public class {b} extends Base<String> implements Priced {
    private final List<String> names_{s};
    int size;

    public {b}(int size, List<String> names) {
        super(size);
        this.size = size;
    }

    @Override
    public int run_{n}(String x) {
        Item item = new Item({s});
        item.touch_{n}(x);
        return helper(this.size) + super.total();
    }

    enum Kind_{s} { SMALL, LARGE }

    interface Priced { int price_{n}(); }
}
''', (
        ('annotation', 'Entity', 'class {b}', '@Entity\npublic class {b} extends Base<String> implements Priced', 6, 6),
        ('annotation', 'Override', 'method run_{n}', '@Override\npublic int run_{n}(String x)', 16, 16),
        ('call', 'super', '{b}.{b}', None, 12, 12),
        ('call', 'Item', '{b}.run_{n}', None, 18, 18),
        ('call', 'touch_{n}', '{b}.run_{n}', 'item', 19, 19),
        ('call', 'helper', '{b}.run_{n}', None, 20, 20),
        ('call', 'total', '{b}.run_{n}', 'super()', 20, 20),
        ('class', '{b}', 'class', '{b},run_{n}|Base,Priced', 6, 26),
        ('class', 'Kind_{s}', 'enum', '|', 23, 23),
        ('class', 'Priced', 'interface', 'price_{n}|', 25, 25),
        ('field', 'names_{s}', '{b}', 'List<String>', 8, 8),
        ('field', 'size', '{b}', 'int', 9, 9),
        ('function', '{b}', '{b}', 'size:int,names:List<String>', 11, 14),
        ('function', 'run_{n}', '{b}', 'x:String', 16, 21),
        ('function', 'price_{n}', 'Priced', '', 25, 25),
        ('import', 'java.util.List', None, None, 3, 3),
        ('import', 'java.lang.Math', None, None, 4, 4),
        ('ref', '{b}', 'identifier', None, 7, 7),
        ('ref', 'names_{s}', 'identifier', None, 8, 8),
        ('ref', '{b}', 'identifier', None, 11, 11),
        ('ref', 'run_{n}', 'identifier', None, 17, 17),
        ('ref', 'touch_{n}', 'identifier', None, 19, 19),
        ('ref', 'Kind_{s}', 'identifier', None, 23, 23),
        ('ref', 'price_{n}', 'identifier', None, 25, 25),
    )),
    "go": ('''package shop

import (
	"fmt"
	str "strings"
)

type Base struct{ ID int }

type {b} struct {
	*Base
	Items_{s} []string
	next  func(x int) error
}

type Store interface {
	Load_{n}(id int) error
}

func (c *{b}) Run_{n}(rate float64, xs ...int) int {
	helper_{s}(1)
	return c.Base.sum(str.ToUpper("x"))
}

func helper_{s}(int, string) error {
	fmt.Println("{n}")
	return nil
}
''', (
        ('call', 'helper_{s}', '{b}.Run_{n}', None, 21, 21),
        ('call', 'ToUpper', '{b}.Run_{n}', 'str', 22, 22),
        ('call', 'sum', '{b}.Run_{n}', 'c.Base', 22, 22),
        ('call', 'Println', 'helper_{s}', 'fmt', 26, 26),
        ('class', 'Base', 'struct', '|', 8, 8),
        ('class', '{b}', 'struct', 'Run_{n}|Base', 10, 14),
        ('class', 'Store', 'interface', 'Load_{n}|', 16, 18),
        ('field', 'ID', 'Base', 'int', 8, 8),
        ('field', 'Base', '{b}', '*Base', 11, 11),
        ('field', 'Items_{s}', '{b}', '[]string', 12, 12),
        ('field', 'next', '{b}', 'func(x int) error', 13, 13),
        ('function', 'Run_{n}', '{b}', 'rate:float64,xs:...int', 20, 23),
        ('function', 'helper_{s}', None, ':int,:string', 25, 28),
        ('import', 'fmt', None, None, 4, 4),
        ('import', 'strings', None, None, 5, 5),
        ('ref', 'shop', 'package_identifier', None, 1, 1),
        ('ref', 'str', 'package_identifier', None, 5, 5),
        ('ref', 'Base', 'type_identifier', None, 8, 8),
        ('ref', 'ID', 'field_identifier', None, 8, 8),
        ('ref', 'int', 'type_identifier', None, 8, 8),
        ('ref', '{b}', 'type_identifier', None, 10, 10),
        ('ref', 'Base', 'type_identifier', None, 11, 11),
        ('ref', 'Items_{s}', 'field_identifier', None, 12, 12),
        ('ref', 'string', 'type_identifier', None, 12, 12),
        ('ref', 'next', 'field_identifier', None, 13, 13),
        ('ref', 'x', 'identifier', None, 13, 13),
        ('ref', 'int', 'type_identifier', None, 13, 13),
        ('ref', 'error', 'type_identifier', None, 13, 13),
        ('ref', 'Store', 'type_identifier', None, 16, 16),
        ('ref', 'Load_{n}', 'field_identifier', None, 17, 17),
        ('ref', 'id', 'identifier', None, 17, 17),
        ('ref', 'int', 'type_identifier', None, 17, 17),
        ('ref', 'error', 'type_identifier', None, 17, 17),
        ('ref', 'c', 'identifier', None, 20, 20),
        ('ref', '{b}', 'type_identifier', None, 20, 20),
        ('ref', 'Run_{n}', 'field_identifier', None, 20, 20),
        ('ref', 'rate', 'identifier', None, 20, 20),
        ('ref', 'float64', 'type_identifier', None, 20, 20),
        ('ref', 'xs', 'identifier', None, 20, 20),
        ('ref', 'int', 'type_identifier', None, 20, 20),
        ('ref', 'helper_{s}', 'identifier', None, 21, 21),
        ('ref', 'c', 'identifier', None, 22, 22),
        ('ref', 'Base', 'field_identifier', None, 22, 22),
        ('ref', 'sum', 'field_identifier', None, 22, 22),
        ('ref', 'str', 'identifier', None, 22, 22),
        ('ref', 'ToUpper', 'field_identifier', None, 22, 22),
        ('ref', 'helper_{s}', 'identifier', None, 25, 25),
        ('ref', 'int', 'type_identifier', None, 25, 25),
        ('ref', 'string', 'type_identifier', None, 25, 25),
        ('ref', 'error', 'type_identifier', None, 25, 25),
        ('ref', 'fmt', 'identifier', None, 26, 26),
        ('ref', 'Println', 'field_identifier', None, 26, 26),
    )),
    "javascript": ('''import { pick } from "./pkg{s}";
const fs = require('fs');

class Base {
  limit_{s} = {s};
  total_{n}(a, b = 1, ...rest) { return helper_{s}(a); }
}

export class {b} extends Base {
  constructor(api) {
    super(api);
    this.api = new Api();
  }
  run_{n}({ x, y }) {
    this.api.send_{n}(x);
    return this.total_{n}(y);
  }
}

const make_{n} = (z) => new {b}(z);

function main_{n}(a) {
  const r = make_{n}(a);
  r.run_{n}(a);
}
''', (
        ('call', 'require', '-', None, 2, 2),
        ('call', 'helper_{s}', 'Base.total_{n}', None, 6, 6),
        ('call', 'constructor', '{b}.constructor', 'super()', 11, 11),
        ('call', 'constructor', '{b}.constructor', 'Api', 12, 12),
        ('call', 'send_{n}', '{b}.run_{n}', 'this.api', 15, 15),
        ('call', 'total_{n}', '{b}.run_{n}', 'this', 16, 16),
        ('call', 'constructor', 'make_{n}', '{b}', 20, 20),
        ('call', 'make_{n}', 'main_{n}', None, 23, 23),
        ('call', 'run_{n}', 'main_{n}', 'r', 24, 24),
        ('class', 'Base', 'class', 'total_{n}|', 4, 7),
        ('class', '{b}', 'class', 'constructor,run_{n}|Base', 9, 18),
        ('field', 'limit_{s}', 'Base', None, 5, 5),
        ('field', 'api', '{b}', 'Api', 12, 12),
        ('function', 'total_{n}', 'Base', 'a:,b:,rest:', 6, 6),
        ('function', 'constructor', '{b}', 'api:', 10, 13),
        ('function', 'run_{n}', '{b}', '{ x, y }:', 14, 17),
        ('function', 'make_{n}', None, 'z:', 20, 20),
        ('function', 'main_{n}', None, 'a:', 22, 25),
        ('import', './pkg{s}', None, None, 1, 1),
        ('import', 'fs', None, None, 2, 2),
        ('ref', 'limit_{s}', 'property_identifier', None, 5, 5),
        ('ref', 'helper_{s}', 'identifier', None, 6, 6),
        ('ref', 'total_{n}', 'property_identifier', None, 6, 6),
        ('ref', '{b}', 'identifier', None, 9, 9),
        ('ref', 'run_{n}', 'property_identifier', None, 14, 14),
        ('ref', 'send_{n}', 'property_identifier', None, 15, 15),
        ('ref', 'total_{n}', 'property_identifier', None, 16, 16),
        ('ref', '{b}', 'identifier', None, 20, 20),
        ('ref', 'make_{n}', 'identifier', None, 20, 20),
        ('ref', 'main_{n}', 'identifier', None, 22, 22),
        ('ref', 'make_{n}', 'identifier', None, 23, 23),
        ('ref', 'run_{n}', 'property_identifier', None, 24, 24),
    )),
    "typescript": ('''import { Api } from './api{s}';

export interface Priced_{s} { price: number; }

enum Kind { Small, Large }

abstract class Base<T> {
  protected limit_{s}: number = {s};
  abstract cost(): number;
}

export class {b} extends Base<string> implements Priced_{s} {
  constructor(private api: Api, readonly size: number) {
    super();
  }
  run_{n}(x: string, y?: number): void {
    this.api.send_{n}(x);
  }
}

export function main_{n}(a: {b}, b = 1): void {
  a.run_{n}('x');
}
''', (
        ('call', 'constructor', '{b}.constructor', 'super()', 14, 14),
        ('call', 'send_{n}', '{b}.run_{n}', 'this.api', 17, 17),
        ('call', 'run_{n}', 'main_{n}', 'a', 22, 22),
        ('class', 'Priced_{s}', 'interface', '|', 3, 3),
        ('class', 'Kind', 'enum', '|', 5, 5),
        ('class', 'Base', 'abstract_class', 'cost|', 7, 10),
        ('class', '{b}', 'class', 'constructor,run_{n}|Base,Priced_{s}', 12, 19),
        ('field', 'limit_{s}', 'Base', 'number', 8, 8),
        ('field', 'api', '{b}', 'Api', 13, 13),
        ('field', 'size', '{b}', 'number', 13, 13),
        ('function', 'constructor', '{b}', 'api:Api,size:number', 13, 15),
        ('function', 'run_{n}', '{b}', 'x:string,y:number', 16, 18),
        ('function', 'main_{n}', None, 'a:{b},b:', 21, 23),
        ('import', './api{s}', None, None, 1, 1),
        ('ref', 'Priced_{s}', 'type_identifier', None, 3, 3),
        ('ref', 'limit_{s}', 'property_identifier', None, 8, 8),
        ('ref', '{b}', 'type_identifier', None, 12, 12),
        ('ref', 'Priced_{s}', 'type_identifier', None, 12, 12),
        ('ref', 'run_{n}', 'property_identifier', None, 16, 16),
        ('ref', 'send_{n}', 'property_identifier', None, 17, 17),
        ('ref', '{b}', 'type_identifier', None, 21, 21),
        ('ref', 'main_{n}', 'identifier', None, 21, 21),
        ('ref', 'run_{n}', 'property_identifier', None, 22, 22),
    )),
    "tsx": ('''import { View } from './view{s}';

type Props_{s} = { title: string };

class {b} extends Component {
  state_{s}: number = {s};
  render_{n}() { return draw_{n}(this.state_{s}); }
}

export const Card_{n} = (p: Props_{s}) => {
  return show_{s}(p);
};
''', (
        ('call', 'draw_{n}', '{b}.render_{n}', None, 7, 7),
        ('call', 'show_{s}', 'Card_{n}', None, 11, 11),
        ('class', 'Props_{s}', 'alias', '|', 3, 3),
        ('class', '{b}', 'class', 'render_{n}|Component', 5, 8),
        ('field', 'state_{s}', '{b}', 'number', 6, 6),
        ('function', 'render_{n}', '{b}', '', 7, 7),
        ('function', 'Card_{n}', None, 'p:Props_{s}', 10, 12),
        ('import', './view{s}', None, None, 1, 1),
        ('ref', 'View', 'identifier', None, 1, 1),
        ('ref', 'Props_{s}', 'type_identifier', None, 3, 3),
        ('ref', 'title', 'property_identifier', None, 3, 3),
        ('ref', '{b}', 'type_identifier', None, 5, 5),
        ('ref', 'Component', 'identifier', None, 5, 5),
        ('ref', 'state_{s}', 'property_identifier', None, 6, 6),
        ('ref', 'draw_{n}', 'identifier', None, 7, 7),
        ('ref', 'render_{n}', 'property_identifier', None, 7, 7),
        ('ref', 'state_{s}', 'property_identifier', None, 7, 7),
        ('ref', 'Card_{n}', 'identifier', None, 10, 10),
        ('ref', 'p', 'identifier', None, 10, 10),
        ('ref', 'Props_{s}', 'type_identifier', None, 10, 10),
        ('ref', 'show_{s}', 'identifier', None, 11, 11),
        ('ref', 'p', 'identifier', None, 11, 11),
    )),
}

QUERIES = {f"extract_{language}": _query(language) for language in SOURCES}
ORACLE_SQL = {f"extract_{language}": _sql(language) for language in SOURCES}
