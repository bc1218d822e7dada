"""Scalar functions and predicates of the code-graph model."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entity kinds and edge types of the model.
ENTITY_KINDS = ("REPOSITORY", "MODULE", "FILE", "FUNCTION", "METHOD", "CONSTRUCTOR", "CLASS", "INTERFACE", "TYPE_ALIAS", "ENUM", "VARIABLE", "COMPONENT", "API_ROUTE", "TEST", "EXTERNAL_PACKAGE", "UNRESOLVED")
EDGE_TYPES = ("CONTAINS", "IMPORTS", "EXPORTS", "CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "INSTANTIATES", "ROUTES_TO", "TESTS", "DEPENDS_ON", "POSSIBLE_CALL")


@F.pandas_udf(StringType())
def nfc(s):
    """Unicode NFC; Spark has no built-in."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def path_problem(path: Column) -> Column:
    """Why a path isn't a repository-relative one, else null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return (
        F.when(path.isNull(), "NULL")
        .when(F.contains(path, F.lit("\x00")), "NUL")
        .when(p.startswith("/") | p.rlike("^[A-Za-z]:"), "ABSOLUTE")
        .when(F.array_contains(parts, ".."), "PARENT")
        .when(F.size(parts) == 0, "EMPTY")
    )


def normalized_path(path: Column, unicode_form: bool = True) -> Column:
    """Relative path with / separators, without empty and . segments; null where ``path_problem`` isn't."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    out = F.when(path_problem(path).isNull(), F.array_join(parts, "/"))
    return nfc(out) if unicode_form else out


def line_count(text: Column) -> Column:
    """0 for empty text, else the pieces between line ends, so a final line end adds one."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\r?\n", -1)))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def valid_confidence(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)


def commit_sha(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), low)


def object_key(digest: Column) -> Column:
    """source/sha256/<first two>/<digest>."""
    return F.concat(F.lit("source/sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def digest_of_key(key: Column) -> Column:
    """Inverse of ``object_key``; null for malformed keys or a prefix that disagrees."""
    d = F.regexp_extract(key, "^source/sha256/[0-9a-f]{2}/([0-9a-f]{64})$", 1)
    return F.when((d != "") & (object_key(d) == key), d)


#: Runtime built-in modules, each named without its prefix and subpath.
BUILTINS = ("_http_agent", "_http_client", "_http_common", "_http_incoming", "_http_outgoing", "_http_server", "_stream_duplex", "_stream_passthrough", "_stream_readable", "_stream_transform", "_stream_wrap", "_stream_writable", "_tls_common", "_tls_wrap", "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib")
#: Built-in modules with a subpath, and those that exist with the prefix only.
BUILTIN_PATHS = ("assert/strict", "dns/promises", "fs/promises", "inspector/promises", "path/posix", "path/win32", "readline/promises", "stream/consumers", "stream/promises", "stream/web", "timers/promises", "util/types")
PREFIX_ONLY = ("sea", "sqlite", "test", "test/reporters")


def package_reference(spec: Column) -> Column:
    """struct(ecosystem, package, subpath) of an import specifier; null where it names no package.

    Null are relative, absolute, private (#), backslash and URL forms, and those with an empty, . or .. segment.  Built-ins give
    NODE_BUILTIN and node:<root>, others NPM; a scoped package keeps two segments.
    """
    bare = F.regexp_replace(spec, "^node:", "")
    root = F.element_at(F.split(bare, "/"), 1)
    builtin = bare.isin(*BUILTINS, *BUILTIN_PATHS) | (spec.startswith("node:") & bare.isin(*PREFIX_ONLY))
    parts = F.split(spec, "/")
    refused = spec.isNull() | (spec == "") | spec.startswith(".") | spec.startswith("/") | spec.startswith("#") | F.contains(spec, F.lit("\\")) | (spec.rlike("^[A-Za-z][A-Za-z+.-]*:") & ~spec.startswith("node:"))
    bad = F.exists(parts, lambda p: p.isin("", ".", "..")) | (spec.startswith("@") & ((F.size(parts) < 2) | (F.element_at(parts, 1) == "@")))
    keep = F.when(spec.startswith("@"), 2).otherwise(1)
    rest = lambda p, n: F.when(F.size(p) > n, F.array_join(F.slice(p, n + 1, F.greatest(F.size(p) - n, F.lit(0))), "/"))
    own = lambda ecosystem, package, subpath: F.struct(F.lit(ecosystem).alias("ecosystem"), package.alias("package"), subpath.alias("subpath"))
    npm = own("NPM", F.array_join(F.slice(parts, 1, keep), "/"), rest(parts, keep))
    node = own("NODE_BUILTIN", F.concat(F.lit("node:"), root), rest(F.split(bare, "/"), F.lit(1)))
    return F.when(~refused & builtin, node).when(~refused & ~bad, npm)


def external_package(spec: Column) -> Column:
    """Package name of an import specifier, or null; see ``package_reference``."""
    return package_reference(spec)["package"]


def sanitized_failure(text: Column, most: int = 500) -> Column:
    """URL-like tokens hidden, then cut to ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"[A-Za-z][A-Za-z0-9+.-]*://\S+", "[redacted-url]"), 1, most)


def per_second(n: Column, seconds: Column) -> Column:
    return F.when(seconds == 0, F.lit(0.0)).otherwise(n / seconds)


def per_second_rounded(n: Column, milliseconds: Column) -> Column:
    """Whole items a second; 0 for no time."""
    return F.when(milliseconds <= 0, F.lit(0).cast("long")).otherwise(F.floor(n * 1000 / milliseconds + 0.5))


def json_string(c: Column) -> Column:
    """A JSON string as JavaScript writes it: quotes, backslashes and control characters escaped, nothing else; null for null."""
    out = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    for code, mark in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        out = F.replace(out, F.lit(chr(code)), F.lit("\\" + mark))
    for code in (*range(8), 11, *range(14, 32)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_boolean(c: Column) -> Column:
    return F.coalesce(c.cast("boolean").cast("string"), F.lit("null"))


def json_list(*parts: Column) -> Column:
    """A JSON array of values that are JSON already."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """A JSON object of values that are JSON already, its keys in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]), F.lit("}"))


def canonical_array(*cols: Column) -> Column:
    """JSON array of strings, the text that identities hash; null stands as null."""
    return json_list(*[json_string(c) for c in cols])


def _hashed(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:v1:sha256:"), F.sha2(text, 256))


def trimmed(text: Column, unicode_form: bool = True) -> Column:
    """Text without white space around it, in NFC; null where nothing is left."""
    t = F.regexp_replace(text, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")
    return F.when(t != "", nfc(t) if unicode_form else t)


def named_identity(path: Column, kind: Column, qualified_name: Column) -> Column:
    return _hashed("sk", canonical_array(F.lit("loom-entity-v1"), path, kind, qualified_name))


def repository_identity(repository: Column, unicode_form: bool = True) -> Column:
    """Null for a blank name."""
    name = trimmed(repository, unicode_form)
    return F.when(name.isNotNull(), _hashed("sk", canonical_array(F.lit("loom-repository-v1"), F.lit("REPOSITORY"), name)))


def package_identity(ecosystem: Column, package: Column, unicode_form: bool = True) -> Column:
    """Null for a blank name."""
    name = trimmed(package, unicode_form)
    return F.when(name.isNotNull(), _hashed("sk", canonical_array(F.lit("loom-package-v1"), F.lit("EXTERNAL_PACKAGE"), ecosystem, name)))


def anonymous_identity(path: Column, kind: Column, parent: Column, role: Column, fingerprint: Column) -> Column:
    return _hashed("sk", canonical_array(F.lit("loom-anonymous-v1"), path, kind, parent, role, fingerprint))


def edge_identity(source: Column, target: Column, edge_type: Column, resolver: list[Column], evidence: list[Column] | None = None) -> Column:
    """Key of an edge occurrence.  ``resolver``: analyzer, its version, resolver, its version; ``evidence``: file path, start line and
    column, end line and column, kind; without it (or where its path is null) the occurrence has none."""
    head = [json_string(F.lit("loom-edge-v1")), json_string(source), json_string(target), json_string(edge_type), *[json_string(c) for c in resolver]]
    none = json_list(*head, json_string(F.lit("NO_EVIDENCE")))
    if evidence is None:
        return _hashed("ek", none)
    path, *numbers, kind = evidence
    return _hashed("ek", F.when(path.isNull(), none).otherwise(json_list(*head, json_string(path), *[json_number(n) for n in numbers], json_string(kind))))


def normalized_text(text: Column, unicode_form: bool = True) -> Column:
    """Line ends as line feeds, in NFC."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    return nfc(t) if unicode_form else t


def declaration_fingerprint(kind: Column, exported: Column, default_export: Column, text: Column, unicode_form: bool = True) -> Column:
    """Of a declaration's normalised text; the structured fields that only some callers fill stand empty."""
    empty = F.lit("[]")
    fields = {k: empty for k in ("heritage", "modifiers", "overloads", "parameters", "typeParameters")}
    nothing = {k: F.lit("null") for k in ("returnType", "visibility")}
    return _hashed("df", json_object(schemaVersion=F.lit("1"), kind=json_string(kind), exported=json_boolean(exported), defaultExport=json_boolean(default_export), normalizedDeclarationText=json_string(normalized_text(text, unicode_form)), **fields, **nothing))


def implementation_fingerprint(kind: Column, normalization: Column, body: Column, unicode_form: bool = True) -> Column:
    """Null without a body."""
    text = json_object(schemaVersion=F.lit("1"), kind=json_string(kind), normalizationVersion=json_string(normalization), normalizedBody=json_string(normalized_text(body, unicode_form)))
    return F.when(body.isNotNull(), _hashed("if", text))


def local_fingerprint(text: Column, unicode_form: bool = True) -> Column:
    return _hashed("lf", normalized_text(text, unicode_form))


def pascal_case(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Za-z0-9]*$")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_name(path: Column) -> Column:
    """What stands before the last /; . for a bare name."""
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(F.contains(path, F.lit("/")), cut).otherwise(".")


def entity_locator(path: Column, kind: Column, qualified_name: Column) -> Column:
    return F.concat_ws("|", path, kind, qualified_name)


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "[\"']", "")


def confidence_level(c: Column) -> Column:
    """EXACT, HIGH, MEDIUM, LOW of a valid confidence, else null."""
    return F.when(valid_confidence(c), F.when(c == 1, "EXACT").when(c >= 0.8, "HIGH").when(c >= 0.5, "MEDIUM").otherwise("LOW"))


def repository_relative(root: Column, path: Column, unicode_form: bool = True) -> Column:
    """Path below a root folder, normalised; null outside it."""
    r = F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), normalized_path(F.substring(p, F.length(r) + 2, F.length(p)), unicode_form))


def valid_position(line: Column, column: Column) -> Column:
    return line.isNotNull() & column.isNotNull() & (line >= 1) & (column >= 1)


def artifact_intact(content: Column, digest: Column, n_bytes: Column) -> Column:
    """Whether stored bytes have the digest and length they should."""
    return (F.sha2(content, 256) == digest) & (F.octet_length(content) == n_bytes)
