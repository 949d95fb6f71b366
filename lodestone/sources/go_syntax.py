"""Go sources as tokens, and the declarations that follow from them.

One alternation cuts a whole file into comments, literals, names, operators and
blanks, so that a mark inside a comment or a literal is none. Lines, offsets and
open brackets are running sums over a file's tokens; a line that ends in a name, a
literal or a closing bracket ends its statement, as the language says. What stands
at which depth of which statement then tells imports, functions, methods, types and
values, however the source is laid out.

Tokens never leave the task that reads their file: the sums are taken over the arrays
of many files at once, and a row is a specification with the tokens that declare it.

Files are rows (path, content). A file that does not begin with its package, ends
inside a comment or literal, or leaves a bracket open or closes one too many has
the status failed and gives no rows beyond that. A null content is an empty file,
and failed. Files of one path are read each by itself; callers should rule them out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import directory

#: Characters that count as alphanumeric to a regular expression and are neither letters nor decimal digits.
_ODD = "".join(f"\\U{c:08x}" for c in range(0x80, 0x110000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal())
#: Names (ASCII ones first, for speed), blanks before a token, comments, raw and quoted strings, runes, numbers, operators, line ends; possessive, so nothing is tried twice.
TOKEN = re.compile(r"[ \t\r\f\v]*+(?:" + "|".join((
    r"[A-Za-z_][A-Za-z0-9_]*+(?![^\x00-\x7f])", rf"[^\W\d{_ODD}][^\W{_ODD}]*+", r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\Z)", r"`[^`]*+`", r'"(?:[^"\\\n]|\\[^\n\r\x85\u2028\u2029])*+"', r"'(?:[^'\\\n]|\\[^\n\r\x85\u2028\u2029])++'",
    r"\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*+", r"\+\+|--|\.\.\.|:=|[=!<>]=|<-", r"(?s:.)", r"\Z",
)) + ")")
#: Words that end a statement at a line's end; other keywords do not.
ENDING = ("break", "continue", "fallthrough", "return")
#: The language's keywords: fixed values.
KEYWORDS = (
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import",
    "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var",
)


#: What a token can be. open is a quote or comment that is never closed, end the end of a statement.
KINDS = ("line", "blank", "open", "comment", "literal", "keyword", "name", "mark", "end")
LINE, BLANK, OPEN, COMMENT, LITERAL, KEYWORD, NAME, MARK, END = range(len(KINDS))
#: Bytes of files that are placed at once, and at least one file; a task holds about 150 bytes for each.
PLACED = 1 << 20
FILE = "path string, package string, status string"
SPECIFICATION = "path string, package string, word string, line long, offset long, tokens array<struct<line long, offset long, token string, kind string, level int>>"


def _kinds(words: pa.Array) -> np.ndarray:
    """The kind of each of some distinct tokens."""
    test = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    long = pc.binary_length(words).to_numpy(zero_copy_only=False)
    starred, quoted = test(r"^/\*"), test("^[\"`']")
    choice = [
        (test(r"^\n\z"), LINE), (test(r"^[ \t\r\f\v]*\z"), BLANK), (starred & ~(test(r"\*/\z") & (long > 3)), OPEN), (starred | test("^//"), COMMENT), (quoted & (long > 1), LITERAL), (quoted, OPEN),
        (test(r"^\.?[0-9]"), LITERAL), (pc.is_in(words, pa.array(KEYWORDS)).to_numpy(zero_copy_only=False), KEYWORD), (test(r"^[\p{L}_]"), NAME),
    ]
    return np.select([x for x, _ in choice], [k for _, k in choice], MARK).astype(np.int8)


def _before(x: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of x over what stands before each place in its run; runs begin at begins and have sizes."""
    total = np.cumsum(x, dtype=np.int64) - x
    return total - np.repeat(total[begins], sizes)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their sizes."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, n))


def _placed(texts: list[str]) -> dict[str, np.ndarray | pa.Array]:
    """The tokens that count, of some files' texts: file, word (its number in names), line, offset, kind and depth (brackets open before it), and statement (those ended outside all brackets before it).

    Statement ends stand where line ends do that are such.
    """
    found = [TOKEN.findall(x) for x in texts]
    counts = np.array([len(x) for x in found], dtype=np.int64)
    coded = pa.array(chain.from_iterable(found), pa.string(), size=int(counts.sum())).dictionary_encode()
    bare = pc.ascii_ltrim(coded.dictionary, characters=" \t\r\f\v")
    ahead = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) - pc.binary_length(bare).to_numpy(zero_copy_only=False)
    again, raw = bare.dictionary_encode(), coded.indices.to_numpy()
    names, word, ahead = again.dictionary, again.indices.to_numpy()[raw], ahead[raw]
    extra = pc.index_in(pa.array([";"]), names).to_pylist()[0]
    if extra is None:
        names, extra = pa.concat_arrays([names, pa.array([";"], names.type)]), len(names)
    kinds = _kinds(names)
    lines, octets = pc.count_substring(names, "\n").to_numpy(zero_copy_only=False), pc.binary_length(names).to_numpy(zero_copy_only=False)
    file = np.repeat(np.arange(len(counts)), counts)
    begins = (np.cumsum(counts) - counts)[counts > 0]
    sizes = counts[counts > 0]
    line, offset, kind = _before(lines[word], begins, sizes) + 1, _before(octets[word] + ahead, begins, sizes) + ahead, kinds[word]
    # A comment over several lines ends a line too.
    keep = np.flatnonzero((kind != BLANK) & ((kind != COMMENT) | (lines[word] > 0)))
    ending = pc.is_in(names, pa.array([")", "]", "}", "++", "--", *ENDING])).to_numpy(zero_copy_only=False) | (kinds == NAME) | (kinds == LITERAL)
    file, word, line, offset, kind = file[keep], word[keep], line[keep], offset[keep], kind[keep]
    ends = (kind == LINE) | (kind == COMMENT)
    stop = np.zeros(len(word), dtype=bool)
    stop[1:] = ends[1:] & ending[word[:-1]] & (file[1:] == file[:-1])
    keep = np.flatnonzero(stop | ~ends)
    file, line, offset = file[keep], line[keep], offset[keep]
    word = np.where(stop[keep], extra, word[keep])
    kind = np.where(word == extra, END, kind[keep])
    if len(word):
        begins, sizes = _runs(file)
        change = pc.is_in(names, pa.array(["(", "[", "{"])).to_numpy(zero_copy_only=False).astype(np.int8) - pc.is_in(names, pa.array([")", "]", "}"])).to_numpy(zero_copy_only=False)
        after = change[word]
        depth = _before(after, begins, sizes)
        statement = _before((kind == END) & (depth == 0), begins, sizes)
    else:
        after = depth = statement = np.zeros(0, dtype=np.int64)
    return {"names": names, "file": file, "word": word, "line": line, "offset": offset, "kind": kind, "depth": depth, "after": depth + after, "statement": statement}


def _parsed(t: dict, files: int) -> tuple[np.ndarray, np.ndarray]:
    """Which files are parsed, and the number of each one's package name among the names, -1 for none."""
    good, package = np.zeros(files, dtype=bool), np.full(files, -1)
    if not len(t["file"]):
        return good, package
    begins, _ = _runs(t["file"])
    at = t["file"][begins]
    said = np.flatnonzero((t["kind"] == NAME) | (t["kind"] == END))
    second, where = np.unique(t["file"][said], return_index=True)
    named = t["kind"][said[where]] == NAME
    package[second[named]] = t["word"][said[where]][named]
    first = pc.equal(t["names"], "package").to_numpy(zero_copy_only=False)[t["word"][begins]]
    least, left = np.minimum.reduceat(t["after"], begins), t["after"][np.append(begins[1:], len(t["file"])) - 1]
    good[at] = first & (least >= 0) & (left == 0) & ~np.logical_or.reduceat(t["kind"] == OPEN, begins) & (package[at] >= 0)
    return good, np.where(good, package, -1)


def _declared(t: dict, good: np.ndarray) -> dict[str, np.ndarray]:
    """Places of the tokens that declare something in parsed files, with spec, the place where the specification's statement begins, word and level."""
    names, at = t["names"], np.flatnonzero(good[t["file"]])
    if not len(at):
        return {k: np.zeros(0, dtype=np.int64) for k in ("at", "spec", "begin", "word", "level")}
    is_in = lambda *x: pc.is_in(names, pa.array(x)).to_numpy(zero_copy_only=False)
    begins, sizes = _runs(t["file"][at], t["statement"][at])
    word, second = t["word"][at[begins]], t["word"][at[np.minimum(begins + 1, len(at) - 1)]]
    base = np.repeat((is_in("(")[second] & (sizes > 1) & ~is_in("func")[word]).astype(np.int64), sizes)
    begin, rank, word = np.repeat(at[begins], sizes), np.arange(len(at)) - np.repeat(begins, sizes), np.repeat(word, sizes)
    depth, kind, mark = t["depth"][at], t["kind"][at], t["word"][at]
    spec = _before((kind == END) & (depth == base), begins, sizes)
    closing = (base == 1) & (depth <= 1) & is_in(")")[mark] & (kind == MARK)
    keep = np.flatnonzero(is_in("import", "func", "const", "var", "type")[word] & (rank > base) & ~((kind == END) & (depth <= base)) & ~closing)
    if not len(keep):
        return _declared(t, np.zeros_like(good))
    at, begin, word, level, kind, mark, spec = at[keep], begin[keep], word[keep], (depth - base)[keep], kind[keep], mark[keep], spec[keep]
    begins, sizes = _runs(begin, spec)
    rank, flat = np.arange(len(at)) - np.repeat(begins, sizes), level == 0
    # Of an import its first two tokens, of values the names, of a function what is outside brackets and a method's receiver.
    stops = ~flat | np.where(rank % 2 == 0, kind != NAME, ~is_in(",")[mark])
    opens = flat & is_in("(")[mark]
    receives = np.repeat(opens[begins], sizes) & (_before(opens, begins, sizes) == 1)
    value = is_in("const", "var")[word] & (rank % 2 == 0) & ~stops & (_before(stops, begins, sizes) == 0)
    keep = np.flatnonzero(value | is_in("type")[word] | (is_in("import")[word] & (rank < 2)) | (is_in("func")[word] & (flat | receives)))
    return {"at": at[keep], "spec": np.repeat(np.arange(len(begins)), sizes)[keep], "begin": begin[keep], "word": word[keep], "level": level[keep]}


def _read(files: DataFrame, schema: str, make: Callable[[pa.Array, dict], pa.RecordBatch]) -> DataFrame:
    """Rows that make gives for the paths and the placed tokens of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.binary_length(contents).fill_null(0).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(paths):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PLACED, "right")))
                texts = [(x or b"").decode("utf-8", "replace") for x in contents.slice(low, high - low).to_pylist()]
                yield make(paths.slice(low, high - low), _placed(texts))
                low = high

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def go_files(files: DataFrame) -> DataFrame:
    """(path, package, status) of each file; status is parsed or failed, package null where it failed."""

    def make(paths: pa.Array, t: dict) -> pa.RecordBatch:
        good, package = _parsed(t, len(paths))
        return pa.record_batch([paths, t["names"].take(pa.array(package, mask=package < 0)), pa.array(np.where(good, "parsed", "failed"))], ["path", "package", "status"])

    return _read(files, FILE, make)


def go_specifications(files: DataFrame) -> DataFrame:
    """(path, package, word, line, offset, tokens) of the specifications in parsed files' top-level declarations; word is import, func, const, var or type, and stands at line and offset.

    offset is in bytes. The declaring word, the brackets of a group and what declares
    nothing are left out: bodies and parameters of functions, and types and values of
    constants and variables. Tokens are in order and have line, offset, token, kind (name,
    keyword, literal, mark or end) and level, the number of brackets that are open before it within the specification.
    """

    def make(paths: pa.Array, t: dict) -> pa.RecordBatch:
        good, package = _parsed(t, len(paths))
        d = _declared(t, good)
        at, names = d["at"], t["names"]
        begins, _ = _runs(d["spec"]) if len(at) else (np.zeros(0, dtype=np.int64), None)
        file, begin = t["file"][at[begins]], d["begin"][begins]
        token = pa.StructArray.from_arrays(
            [pa.array(t["line"][at]), pa.array(t["offset"][at]), names.take(pa.array(t["word"][at])), pa.array(KINDS, pa.string()).take(pa.array(t["kind"][at])), pa.array(d["level"].astype(np.int32))], ["line", "offset", "token", "kind", "level"]
        )
        tokens = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), token)
        columns = [paths.take(pa.array(file)), names.take(pa.array(package[file])), names.take(pa.array(d["word"][begins])), pa.array(t["line"][begin]), pa.array(t["offset"][begin]), tokens]
        return pa.record_batch(columns, ["path", "package", "word", "line", "offset", "tokens"])

    return _read(files, SPECIFICATION, make)


def _token(k: int, field: str = "token", of: Column | str = "tokens") -> Column:
    """A field of a specification's kth token, from 1, null where there is none."""
    return F.get(of, F.lit(k - 1))[field]


def _flat(x: Column) -> Column:
    return x["level"] == 0


def go_imports(files: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(path, line, offset, import_path, alias, alias_kind) of Go files (path, content); alias_kind is default, named, blank or dot."""
    one = (go_specifications(files) if specs is None else specs).filter("word = 'import'")
    bare = _token(1, "kind") == "literal"
    text = F.when(bare, _token(1)).otherwise(_token(2))
    alias = F.when(bare, "").otherwise(_token(1))
    kind = F.when(alias == "", "default").when(alias == "_", "blank").when(alias == ".", "dot").otherwise("named")
    said = one.select("path", _token(1, "line").alias("line"), _token(1, "offset").alias("offset"), text.alias("text"), alias.alias("alias"), kind.alias("alias_kind")).filter(F.col("text").rlike(r'^["`].'))
    return said.select("path", "line", "offset", F.expr("substring(text, 2, length(text) - 2)").alias("import_path"), "alias", "alias_kind")


def receiver_type(tokens: Column) -> Column:
    """The type of a method's receiver, given as the tokens between its brackets, joined by blanks."""
    at = lambda k: F.get(tokens, F.lit(k))
    is_name = lambda x: x.rlike(r"^[\p{L}_]")
    named = is_name(at(0)) & (is_name(at(1)) | at(1).isin("*", "("))
    kind = F.array_join(F.when(F.coalesce(named, F.lit(False)), F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens), " ")
    return F.regexp_replace(kind, " ?,$", "")


def receiver(kind: Column) -> dict[str, Column]:
    """receiver_base, pointer and generic of a receiver's type.

    The base is empty where the receiver is no name behind stars and brackets.
    """
    shape = r"^((?:[*(] )*)([\p{L}_][\p{L}\p{Nd}_]*+)((?: \))* \[.*\])?(?: \))*$"
    return {"receiver_base": F.regexp_extract(kind, shape, 2), "pointer": F.regexp_extract(kind, r"^((?:[*(] ?)*)", 1).contains("*"), "generic": F.regexp_extract(kind, shape, 3) != ""}


def _own() -> Column:
    """The tokens of a type specification that are part of the type, and not its name or the list of its parameters."""
    at = _token
    # What follows the name in brackets is an array's length rather than a list of parameters if it is empty, one name, a number or a sum.
    length = at(4).isin("]") | (at(3) == "]") | at(3, "kind").isin("literal") | (at(3) == "...") | (at(4).rlike(r"^[-+/%<>&|^]") | ((at(4) == "*") & (at(5, "kind") == "literal")))
    listed = F.coalesce((at(2) == "[") & ~F.coalesce(length, F.lit(False)), F.lit(False))
    closed = F.array_position(F.transform("tokens", lambda x: (x["level"] == 1) & (x["token"] == "]")), F.lit(True)).cast("int")
    whole, many = F.col("tokens"), F.size("tokens")
    after = F.when(closed > 0, F.slice(whole, closed + 1, many)).otherwise(F.slice(whole, 1, 0))
    return F.when(listed, after).otherwise(F.slice(whole, 2, many))


def _expression(own: Column) -> Column:
    """Tokens joined by blanks, without an alias's mark."""
    return F.array_join(F.transform(F.filter(own, lambda x: ~(_flat(x) & (x["token"] == "="))), lambda x: x["token"]), " ")


def _is_alias() -> Column:
    return F.exists("tokens", lambda x: _flat(x) & (x["token"] == "="))


_SYMBOL = "array<struct<line: bigint, offset: bigint, kind: string, name: string, receiver_base: string, pointer: boolean, generic: boolean>>"


def _symbols(kind_of_type: Column) -> Column:
    """The symbols that a specification declares, as an array; a type is one if kind_of_type is not null."""
    plain = (F.lit(""), F.lit(False), F.lit(False))
    symbol = lambda line, offset, kind, name, of=plain: F.struct(line.alias("line"), offset.alias("offset"), kind.alias("kind"), name.alias("name"), *(v.alias(k) for k, v in zip(("receiver_base", "pointer", "generic"), of, strict=True)))
    name = F.get(F.filter("tokens", lambda x: _flat(x) & (x["kind"] == "name")), F.lit(0))["token"]
    inside = F.filter("tokens", lambda x: (x["level"] > 0) & ~((x["level"] == 1) & (x["token"] == ")")))
    kind = F.array(receiver_type(F.transform(inside, lambda x: x["token"])))
    methods = F.transform(kind, lambda k: symbol(F.col("line"), F.col("offset"), F.lit("method"), name, tuple(receiver(k).values())))
    func = F.when(_token(1) == "(", methods).otherwise(F.array(symbol(F.col("line"), F.col("offset"), F.lit("function"), name)))
    first = F.get("tokens", F.lit(0))
    values = F.transform("tokens", lambda x: symbol(x["line"], x["offset"], F.when(F.col("word") == "const", "constant").otherwise("variable"), x["token"]))
    types = F.when(kind_of_type.isNotNull(), F.array(symbol(first["line"], first["offset"], kind_of_type, first["token"])))
    found = F.when(F.col("word") == "func", F.when(name.isNotNull(), func)).when(F.col("word") == "type", types)
    return found.when(F.col("word").isin("const", "var"), values).cast(_SYMBOL)


def go_symbols(files: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(path, line, offset, kind, name, receiver_base, pointer, generic) of top-level declarations in Go files (path, content).

    A function stands where its word func does, all else where its name does.
    Kinds are function, method, struct, interface, constant and variable. Types
    of other kinds are no symbols.
    """
    specs = go_specifications(files) if specs is None else specs
    shape = F.get(F.filter(_own(), lambda x: _flat(x) & (x["token"] != "=")), F.lit(0))["token"]
    each = specs.filter("word <> 'import'").withColumn("shape", F.when(F.col("word") == "type", shape))
    return each.select("path", F.inline(_symbols(F.when(F.col("shape").isin("struct", "interface"), F.col("shape")))))


def go_types(files: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(path, line, offset, name, alias, expression) of top-level types; the expression is its tokens joined by blanks, without type parameters."""
    rows = (go_specifications(files) if specs is None else specs).filter("word = 'type'")
    return rows.select("path", _token(1, "line").alias("line"), _token(1, "offset").alias("offset"), _token(1).alias("name"), _is_alias().alias("alias"), _expression(_own()).alias("expression"))


def go_declarations(files: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(path, line, offset, kind, syntax, name, scope) of top-level declarations; syntax is the kind of symbol that a declaration must be, null where it need be none.

    Kinds are those of symbols, defined_type and type_alias. The scope is the
    package's, package:folder:name, or for methods and functions named init the
    file's, file:path.
    """
    specs = go_specifications(files) if specs is None else specs
    is_type = F.col("word") == "type"
    each = specs.filter("word <> 'import'").withColumns({"expression": F.when(is_type, _expression(_own())), "alias": F.when(is_type, _is_alias())})
    first = F.col("expression")
    shape = F.when(first.rlike(r"^struct\b"), "struct").when(first.rlike(r"^interface\b"), "interface")
    kind = F.when(F.col("alias"), "type_alias").otherwise(F.coalesce(shape, F.lit("defined_type")))
    found = each.select("path", "package", F.when(is_type, kind).alias("kind_of_type"), shape.alias("shape"), "word", "line", "offset", "tokens")
    found = found.select("path", "package", F.col("kind_of_type").alias("_kind"), F.col("shape"), F.inline(_symbols(F.col("kind_of_type"))))
    syntax = F.when(F.col("_kind").isNotNull(), F.col("shape")).otherwise(F.col("kind"))
    own = (F.col("kind") == "method") | ((F.col("kind") == "function") & (F.col("name") == "init"))
    scope = F.when(own, F.concat(F.lit("file:"), "path")).otherwise(F.concat_ws(":", F.lit("package"), directory(F.col("path")), F.col("package")))
    return found.select("path", "line", "offset", "kind", syntax.alias("syntax"), "name", scope.alias("scope"))


def reconciled(declarations: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """declarations with status, and diagnostics (path, offset, code, name), from the symbols (path, kind, name, offset) that were recorded of the same files.

    A declaration that must be a symbol is resolved if just one agrees in path,
    kind, name and place, partial if none does and ambiguous if several do; others
    are resolved. Symbols that no declaration is alone with are told too.
    """
    key = ["path", "syntax", "name", "offset"]
    known = symbols.withColumnRenamed("kind", "syntax").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    met = declarations.join(known, key, "left")
    status = F.when(F.col("syntax").isNull() | (F.col("_n") == 1), "resolved").when(F.col("_n").isNull(), "partial").otherwise("ambiguous")
    found = met.select(*declarations.columns, status.alias("status"))
    code = F.when(F.col("status") == "partial", "semantic_declaration_unmatched").otherwise("semantic_declaration_ambiguous")
    told = found.filter("status <> 'resolved'").select("path", "offset", code.alias("code"), "name")
    alone = found.filter("status = 'resolved' AND syntax IS NOT NULL").select(*key)
    lost = known.join(alone, key, "left_anti").select("path", "offset", F.lit("semantic_syntax_symbol_unmatched").alias("code"), "name", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))))
    return found, told.union(lost.drop("col"))
