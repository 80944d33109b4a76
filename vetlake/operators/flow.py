"""Recovered text and data flow: encoded tokens, literal constructs, assignments, reachability, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import BASE64_TOKEN, HEX_TOKEN, LONG_TOKEN, decode_layers, interesting
from ..functions.text import bound, has_any, jrx, let, ws_trim
from .reach import reach, walk

# Construct patterns.
CONCAT_RX = r"""(?s)[\"'][^\"']{4,}[\"']\s*(?:\+\s*[\"'][^\"']{1,}[\"']\s*){1,}"""
JOIN_RX = r"""(?s)\[(?:\s*[\"'][^\"']+[\"']\s*,?){2,}\s*\]\.join\(\s*[\"']?[^\"')]*[\"']?\s*\)"""
JOIN_BODY_RX = r"""(?s)\[((?:\s*[\"'][^\"']+[\"']\s*,?){2,})\s*\]\.join\(\s*[\"']?([^\"')]*)[\"']?\s*\)"""
CHARCODE_RX = r"(?i)string\.fromcharcode\(([^)]{4,})\)"
TEMPLATE_RX = r"(?s)`([^`]{12,})`"
LITERAL_RX = r"""[\"']([^\"']+)[\"']"""
DECL = r"(?m)(?:const|let|var)\s+([A-Za-z_][\w]*)\s*=\s*"
# Stands in every text that one of the assignments below is found in.
DECL_GUARD = r"(?:const|let|var)\s+[A-Za-z_]\w*\s*="
ASSIGN_RX = {
    "literal": DECL + r"""([\"'][^\"']{4,}[\"'])""",
    "join": DECL + r"""(\[(?:\s*[\"'][^\"']+[\"']\s*,?){2,}\s*\]\.join\(\s*[\"']?[^\"')]*[\"']?\s*\))""",
    "template": DECL + r"(`[^`]{8,}`)",
    "alias": DECL + r"([A-Za-z_][\w]*)\s*$",
    "concat": DECL + r"([^\n;]+(?:\+[^\n;]+)+)",
    "wrapper": DECL + r"(.+?)\s*$",
    "call": DECL + r"([A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)*\([^\n;]*\))",
}
PASS_THROUGH = ["trimspace", "trim", "trimprefix", "trimsuffix", "tolower", "toupper", "sanitize", "clean", "strip", "replaceall", "replace", "join", "format",
                "sprintf", "abs", "resolve", "normalize", "base", "basename", "dir", "dirname"]
SINKS = {
    "exec": r"(?:eval\(|exec\(|subprocess\.(?:run|popen|call)|os\.system\(|exec\.command\(|child_process\.(?:exec|spawn)|runtime\.getruntime\(\)\.exec)",
    "network": r"(?:fetch\(|axios\.(?:get|post|put|delete|request)\(|requests\.(?:get|post|put|delete|request)\(|http\.(?:get|post|newrequest)\(|urllib\.request\.(?:urlopen|request)|client\.do\(|curl\s+[^#\n]*https?://|wget\s+[^#\n]*https?://)",
    "command": r"""(?:bash\s+-c|sh\s+-c|cmd(?:\.exe)?\s+/c|powershell(?:\.exe)?\s+-|start-process\s+|processstartinfo|exec\.command\([^\n)]*(?:"bash"|"sh"|"cmd"|"cmd\.exe"|"powershell"|"powershell\.exe")|curl\s+[^#\n]*\||wget\s+[^#\n]*\|)""",
}
# Sinks that run on to the last of several possible ends, each with the pattern of such an end.
_URL_END, _PIPE_END = r"(?i)(?<=https?://)", r"(?<=\|)"
_SHELL_END = r"""(?i)(?<="bash"|"sh"|"cmd"|"cmd\.exe"|"powershell"|"powershell\.exe")"""
OPEN_SINKS = {
    "network": [(r"(?:curl|wget)\s+[^#\n]*https?://", _URL_END)],
    "command": [(r"(?:curl|wget)\s+[^#\n]*\|", _PIPE_END), (r"""exec\.command\([^\n)]*(?:"bash"|"sh"|"cmd"|"cmd\.exe"|"powershell"|"powershell\.exe")""", _SHELL_END)],
}
RESULT_WORDS = {
    "exec": ["exec", "eval", "subprocess", "os.system"], "network": ["http", "fetch", "axios", "requests."], "command": ["bash", "curl", "wget", "cmd"],
}
DECODED_MARKERS = ["decoded:", "base64[", "hex[", "charcode[", "template[", "variable["]
FLOW_REACH = 160
# Rounds over all assignments before those still open are resolved in order of need.
ROUNDS = 4


def _all(c: Column, rx: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(jrx(rx)), F.lit(group))


# --- tokens --------------------------------------------------------------------------------------

def encoded_tokens(files: DataFrame) -> DataFrame:
    """Base64-like and hex-like tokens per file, with the long flag."""
    tagged = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"))
    cells = F.concat(*[F.transform(_all(F.col("content"), rx, 0), tagged(k)) for k, rx in (("base64", BASE64_TOKEN), ("hex", HEX_TOKEN))])
    return files.select("skill_id", "path", F.explode(F.array_distinct(cells)).alias("t")).select("skill_id", "path", "t.kind", "t.token", (F.length("t.token") >= LONG_TOKEN).alias("is_long"))


def decode_tokens(tokens: DataFrame) -> DataFrame:
    """Decoded layers per distinct token of the corpus: token, n_uses, decoded entries.

    A token copied into many files is counted map-side and decoded once.
    """
    distinct = tokens.groupBy("token").agg(F.count("*").alias("n_uses"))
    return distinct.withColumn("layers", decode_layers(F.col("token"))).where(F.size("layers") > 0)


# --- constructs ------------------------------------------------------------------------------------

def merged_literals(c: Column) -> Column:
    """Adjacent literal concatenations of at least 16 bytes."""
    parts = F.transform(_all(c, CONCAT_RX, 0), lambda m: F.array_join(_all(m, LITERAL_RX, 1), ""))
    return F.filter(parts, lambda p: F.octet_length(p) >= 16)


def joined_value(m: Column) -> Column:
    """Array-join call -> joined text."""
    return F.array_join(_all(F.regexp_extract(m, jrx(JOIN_BODY_RX), 1), LITERAL_RX, 1), "\x01")


def joined_literals(c: Column) -> Column:
    vals = F.transform(_all(c, JOIN_RX, 0), lambda m: F.replace(joined_value(m), F.lit("\x01"), F.regexp_extract(m, jrx(JOIN_BODY_RX), 2)))
    return F.filter(vals, lambda v: F.octet_length(v) >= 16)


def _code_point(raw: Column) -> Column:
    s = ws_trim(raw)
    return (F.when(s.rlike(r"^[0-9]{1,7}$"), s.try_cast("int"))
            .when(s.rlike(r"^0[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(s, 3, 10), 16, 10).try_cast("int")))


def _utf8(cp: Column) -> Column:
    """Code point -> character; ``chr`` stops at one byte, so larger points go through UTF-32."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def charcode_texts(c: Column) -> Column:
    """Character-code calls of at least 8 codes whose text looks interesting."""
    def decode(body: Column) -> Column:
        cps = F.transform(F.split(body, ",", -1), _code_point)
        ok = (F.size(cps) >= 8) & F.forall(cps, lambda x: x.isNotNull() & (x <= 0x10FFFF))
        return F.when(ok, ws_trim(F.array_join(F.transform(cps, _utf8), "")))

    texts = F.filter(F.transform(_all(c, CHARCODE_RX, 1), decode), lambda t: t.isNotNull())
    return F.filter(texts, interesting)


# --- variables ---------------------------------------------------------------------------------------

def _pairs(c: Column, kind: str) -> Column:
    # the text is searched once; a match on its own splits as it did in the text
    part = lambda m, i: F.regexp_extract(m, jrx(ASSIGN_RX[kind]), i)
    return F.transform(_all(c, ASSIGN_RX[kind], 0), lambda m: F.struct(F.lit(kind).alias("kind"), part(m, 1).alias("name"), part(m, 2).alias("expr")))


def assignments(c: Column) -> Column:
    """All assignments of a text: array of (kind, name, expr)."""
    # most files assign nothing
    return F.when(c.rlike(DECL_GUARD), F.concat(*[_pairs(c, k) for k in ASSIGN_RX])).otherwise(F.array().cast("array<struct<kind:string,name:string,expr:string>>"))


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["'`]+|["'`]+$""", "")


def unwrapped(expr: Column) -> Column:
    """Strip pass-through calls, however nested, keeping the argument that carries the value."""
    names = "|".join(PASS_THROUGH)
    call = rf"(?is)^(?:[\w.\s]*\.)?({names})\s*\((.*)\)$"
    arg = r"""((?:[^(),"'`]|\([^()]*\)|"[^"]*"|'[^']*'|`[^`]*`)*)"""

    def strip(e: Column, _: Column) -> Column:
        body = ws_trim(F.regexp_extract(e, call, 2))
        name = F.lower(F.regexp_extract(e, call, 1))
        first = ws_trim(F.regexp_extract(body, "^" + arg, 1))
        second = ws_trim(F.regexp_extract(body, "^" + arg + r"\s*,\s*" + arg, 2))
        nested = body.rlike(r"\([^()]*\(")  # deeper nesting: the whole body is one argument unless a comma list is certain
        single = F.when(nested & ~body.rlike(r",[^()]*$"), body).otherwise(first)
        picked = (F.when(name.isin("format", "sprintf"), second).when(name.isin("replace", "replaceall", "trim", "trimprefix", "trimsuffix", "join"), single)
                  .when((single == body), body).otherwise(F.lit("")))
        return F.when(e.rlike(call) & (picked != ""), picked).otherwise(e)

    # a call that is stripped takes its bracket along
    calls = F.coalesce(F.length(expr) - F.length(F.replace(expr, F.lit("("), F.lit(""))), F.lit(0))
    def again(acc: Column, i: Column) -> Column:
        return F.when(acc["go"], let(strip(acc["e"], i), lambda e: F.struct(e.alias("e"), (e != acc["e"]).alias("go")))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(calls, F.lit(1))), F.struct(ws_trim(expr).alias("e"), F.lit(True).alias("go")), again, lambda acc: acc["e"])


def variables(c: Column, items: Column | None = None) -> Column:
    """Variable -> text value after concat, template, alias and wrapper resolution to the end; ``items`` are its assignments, if known.

    Rounds over all assignments end when one changes nothing.  After ``ROUNDS`` of them the values that still change are
    long chains or circles: every variable is then resolved once, as soon as all variables it is made of
    are.  Those of a circle never are; they keep the value of the last round.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def put(m: Column, k: Column, v: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda key, _: key != k), F.map_from_arrays(F.array(k), F.array(v)))

    def seed(m: Column, a: Column) -> Column:
        join_val = F.replace(joined_value(a["expr"]), F.lit("\x01"), F.regexp_extract(a["expr"], jrx(JOIN_BODY_RX), 2))
        v = F.when(a["kind"].isin("literal", "template"), _unquote(a["expr"])).when(a["kind"] == "join", join_val)
        return F.when(v.isNotNull(), put(m, a["name"], v)).otherwise(m)

    def concat_value(m: Column, expr: Column) -> Column:
        toks = _all(expr, r"""[\"'][^\"']*[\"']|[A-Za-z_][\w]*""", 0)
        vals = F.transform(toks, lambda t: F.when(t.rlike(r"""^["']"""), _unquote(t)).otherwise(F.element_at(m, t)))
        ok = (F.size(toks) >= 2) & F.forall(vals, lambda v: v.isNotNull()) & expr.contains("+")
        out = F.array_join(vals, "")
        return F.when(ok & (F.octet_length(out) >= 8), out)

    def rendered(m: Column, tmpl: Column) -> Column:
        norm = F.regexp_replace(tmpl, r"\$\{\s*([A-Za-z_]\w*)\s*\}", r"\${$1}")
        return F.aggregate(F.map_entries(m), norm, lambda acc, e: F.when(e["value"] != "", F.replace(acc, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"])).otherwise(acc))

    def resolve(m: Column, a: Column) -> Column:
        v = (F.when(a["kind"] == "concat", concat_value(m, a["expr"])).when(a["kind"] == "template", rendered(m, _unquote(a["expr"])))
             .when(a["kind"] == "alias", F.element_at(m, a["expr"])).when(a["kind"].isin("wrapper", "call"), F.element_at(m, unwrapped(a["expr"]))))
        return F.when(v.isNotNull() & (v != ""), put(m, a["name"], v)).otherwise(m)

    order = ["concat", "template", "alias", "wrapper", "call"]
    of_kind = lambda kind: lambda a: a["kind"] == kind

    def made_of(a: Column) -> Column:
        names = lambda rx, group: _all(a["expr"], rx, group)
        return (F.when(a["kind"] == "concat", F.filter(names(r"""[\"'][^\"']*[\"']|[A-Za-z_][\w]*""", 0), lambda t: ~t.rlike(r"""^["']""")))
                .when(a["kind"] == "template", names(r"\$\{\s*([A-Za-z_]\w*)\s*\}", 1)).when(a["kind"] == "alias", F.array(a["expr"])).otherwise(F.array(unwrapped(a["expr"]))))

    def rounds(later: Column, start: Column) -> Column:
        def one(acc: Column, _: Column) -> Column:
            changed = lambda m: F.struct(m.alias("m"), (F.map_entries(m) != F.map_entries(acc["m"])).alias("go"))
            return F.when(acc["go"], let(F.aggregate(later, acc["m"], resolve), changed)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(start.alias("m"), F.lit(True).alias("go")), one)

    def in_order(later: Column, start: Column) -> Column:
        def entry(n: Column) -> Column:
            own = F.filter(later, lambda a: a["name"] == n)
            return F.struct(n.alias("name"), own.alias("own"), F.array_distinct(F.flatten(F.transform(own, made_of))).alias("needs"))

        def one(acc: Column, _: Column) -> Column:
            def advance(split: Column) -> Column:
                m = F.aggregate(F.flatten(F.transform(split["ready"], lambda e: e["own"])), acc["m"], resolve)
                return F.struct(m.alias("m"), split["open"].alias("open"), (F.size(split["ready"]) > 0).alias("go"))

            waits = lambda names: F.struct(F.filter(acc["open"], lambda e: ~F.arrays_overlap(e["needs"], names)).alias("ready"), F.filter(acc["open"], lambda e: F.arrays_overlap(e["needs"], names)).alias("open"))
            return F.when(acc["go"], let(let(F.transform(acc["open"], lambda e: e["name"]), waits), advance)).otherwise(acc)

        def walk(entries: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.size(entries)), F.struct(start.alias("m"), entries.alias("open"), F.lit(True).alias("go")), one, lambda acc: acc["m"])

        return let(F.transform(F.array_distinct(F.transform(later, lambda a: a["name"])), entry), walk)

    def solve(items: Column) -> Column:
        seeds = F.filter(items, lambda a: a["kind"].isin("literal", "join", "template"))
        later = F.concat(*[F.filter(items, of_kind(k)) for k in order])
        last = lambda both: let(rounds(both["later"], both["m"]), lambda acc: F.when(acc["go"], in_order(both["later"], acc["m"])).otherwise(acc["m"]))
        return let(F.struct(later.alias("later"), F.aggregate(seeds, empty, seed).alias("m")), last)

    return let(assignments(c) if items is None else items, lambda a: F.when(F.size(a) > 0, solve(a)).otherwise(empty))


def template_texts(c: Column, vars_: Column) -> Column:
    """Template literals of 12 bytes or more, variables filled in, that look interesting."""
    def render(t: Column) -> Column:
        norm = F.regexp_replace(t, r"\$\{\s*([A-Za-z_]\w*)\s*\}", r"\${$1}")
        return ws_trim(F.aggregate(F.map_entries(vars_), norm, lambda acc, e: F.when(e["value"] != "", F.replace(acc, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"])).otherwise(acc)))

    return F.filter(F.transform(_all(c, TEMPLATE_RX, 1), render), lambda t: (t != "") & interesting(t))


def _tagged(texts: Column, tag: str) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(f"{tag}[1]: "), t))


def _layers_of(texts: Column) -> Column:
    return F.flatten(F.transform(texts, decode_layers))


# A file can only yield sections when one of these occurs in it.
SECTION_GUARD = r"(?is)(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20}|[\"']\s*\+\s*[\"']|\.join\(|fromcharcode\(|`[^`]{12}|(?:const|let|var)\s+[A-Za-z_]\w*\s*="


def with_assignments(files: DataFrame) -> DataFrame:
    """Add ``_assignments``, the assignments of the content, which variables, edges and sink windows then read instead of searching for them again."""
    return files.select("*", bound(assignments(F.col("content"))).alias("_assignments"))


def _assignments_of(files: DataFrame) -> Column:
    return F.col("_assignments") if "_assignments" in files.columns else assignments(F.col("content"))


def with_variables(files: DataFrame) -> DataFrame:
    """Add ``_variables``, the resolved variables of the content, which ``with_analysis`` and ``decoded_variables`` then read instead of resolving them again."""
    return files.select("*", bound(variables(F.col("content"), _assignments_of(files))).alias("_variables"))


def _variables_of(files: DataFrame) -> Column:
    return F.col("_variables") if "_variables" in files.columns else variables(F.col("content"), _assignments_of(files))


def section_list(c: Column, vars_: Column | None = None) -> Column:
    """Recovered text of a content, sorted distinct and prefixed by technique; empty where no construct occurs.

    Every intermediate list is bound once, so nothing is decoded twice.
    """
    def assemble(t: Column) -> Column:
        texts = F.array_distinct(F.concat(t["m"], t["j"], t["ch"], t["t"], t["v"], t["tok"]))
        return F.array_sort(F.array_distinct(F.concat(_tagged(t["ch"], "charcode"), _tagged(t["t"], "template"), _tagged(t["v"], "variable"), _layers_of(texts))))

    def parts(vars_: Column) -> Column:
        values = F.filter(F.map_values(vars_), lambda v: (F.octet_length(v) >= 8) & interesting(v))
        tokens = F.concat(_all(c, BASE64_TOKEN, 0), _all(c, HEX_TOKEN, 0))
        bound = F.struct(merged_literals(c).alias("m"), joined_literals(c).alias("j"), charcode_texts(c).alias("ch"), template_texts(c, vars_).alias("t"),
                         F.transform(values, ws_trim).alias("v"), tokens.alias("tok"))
        return let(bound, assemble)

    return F.when(c.rlike(SECTION_GUARD), let(variables(c) if vars_ is None else vars_, parts)).otherwise(F.array().cast("array<string>"))


def decoded_sections(files: DataFrame) -> DataFrame:
    """Files with recovered text: skill_id, path, sections.  Row-local."""
    # ``bound`` keeps the size test below from repeating the whole expression
    return files.where(F.col("content").rlike(SECTION_GUARD)).select("skill_id", "path", bound(section_list(F.col("content"))).alias("sections")).where(F.size("sections") > 0)


def with_analysis(files: DataFrame) -> DataFrame:
    """Add ``preprocessed`` and ``analysis_content`` (raw + decoded text) to files, inside each file's own row."""
    marked = files.select("*", bound(section_list(F.col("content"), _variables_of(files))).alias("_sections"))
    pre = F.when(F.size("_sections") > 0, F.concat(F.lit("\n[preprocessed-decoded]\n"), F.array_join("_sections", "\n")))
    out = marked.withColumn("preprocessed", pre).drop("_sections")
    text = F.when(F.col("preprocessed").isNull(), F.col("content")).otherwise(F.concat("content", F.lit("\n\n"), "preprocessed"))
    return out.select("*", bound(text).alias("analysis_content"))


# --- data flow -------------------------------------------------------------------------------------------

def assignment_edges(files: DataFrame) -> DataFrame:
    """Variable edges: skill_id, path, dst, src, kind.  ``literal`` edges carry the value as src."""
    a = files.select("skill_id", "path", F.explode(_assignments_of(files)).alias("a")).select("skill_id", "path", "a.*")
    kind, expr = F.col("kind"), F.col("expr")
    # one pass over the texts: each assignment gives the names it is made of in its own row
    srcs = (F.when(kind.isin("literal", "join", "alias"), F.array(expr)).when(kind.isin("concat", "call"), F.array_distinct(_all(expr, r"[A-Za-z_][\w]*", 0)))
            .when(kind == "template", F.array_distinct(_all(expr, r"\$\{\s*([A-Za-z_][\w]*)\s*\}", 1))).when(kind == "wrapper", F.filter(F.array(unwrapped(expr)), lambda e: e.rlike(r"^[A-Za-z_]\w*$"))))
    edges = a.select("skill_id", "path", F.col("name").alias("dst"), "kind", bound(srcs).alias("srcs"))
    return edges.select("skill_id", "path", "dst", F.explode("srcs").alias("src"), "kind").where("dst <> src").distinct()


def decoded_variables(files: DataFrame) -> DataFrame:
    """Variables whose value decodes or looks interesting: skill_id, path, name."""
    v = files.select("skill_id", "path", F.explode(_variables_of(files)).alias("name", "value"))
    t = ws_trim(F.col("value"))
    return v.where((t != "") & (interesting(t) | (F.size(decode_layers(t)) > 0))).select("skill_id", "path", "name")


def propagate(edges: DataFrame, seeds: DataFrame, hops: int | None = None, keys: tuple[str, ...] = ("skill_id", "path")) -> DataFrame:
    """Names reachable from the seeds (within ``hops``, if given): keys, name, hop (first hop that reaches it).

    Long paths take rounds in proportion to their logarithm, see ``reach``.
    """
    return reach(edges, seeds, keys) if hops is None else walk(edges, seeds, keys, hops)


def _longest_name(items: Column) -> Column:
    """Length of the longest identifier that one of the assignments names or uses, rounded up to a power of two."""
    names = F.flatten(F.transform(items, lambda a: F.array_append(_all(a["expr"], r"[A-Za-z_]\w*", 0), a["name"])))
    most = F.array_max(F.transform(names, lambda n: F.length(n)))
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.coalesce(most, F.lit(1)), F.lit(16)).cast("double")))).cast("int")


def _before_sinks(c: Column, sink: str, width: Column) -> Column:
    """Up to ``width`` characters before every place where the sink can start."""
    # cut before every start; the mark in front keeps a start at the very beginning apart
    pieces = F.split(F.concat(F.lit("\n"), c), f"(?is)(?={sink})", -1)
    # every piece has a character, so ``width`` of them reach far enough
    before = lambda p, i: F.right(F.array_join(F.slice(p, F.greatest(i - width, F.lit(1)), F.least(i, width + 1)), ""), width)
    return let(pieces, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: before(p, i))).otherwise(F.array().cast("array<string>")))


def _after_sinks(c: Column, kind: str, width: Column) -> Column:
    """Up to ``width`` characters after every place where a sink of the kind can end."""
    follow = lambda rx: F.concat(F.lit(f"(?is)(?=({rx})(.{{0,"), width.cast("string"), F.lit("}))"))
    out = [F.regexp_extract_all(c, follow(SINKS[kind]), F.lit(2))]
    for rx, end in OPEN_SINKS.get(kind, []):
        spans, rest = F.regexp_extract_all(c, follow(rx), F.lit(1)), F.regexp_extract_all(c, follow(rx), F.lit(2))
        # what follows each earlier end: the later parts of the span, then what follows the span
        tails = lambda parts, after: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda j: F.left(F.concat(F.array_join(F.slice(parts, j + 1, F.size(parts)), ""), after), width))
        out.append(F.flatten(F.zip_with(spans, rest, lambda s, r: let(F.split(s, end, -1), lambda parts: tails(parts, r)))))
    return F.concat(*out)


def sink_windows(c: Column, items: Column | None = None) -> Column:
    """Per sink kind what stands within reach before and after it, wide enough for every name of the text; ``items`` are its assignments, if known."""
    def windows(longest: Column) -> Column:
        width = longest + FLOW_REACH
        cells = [F.when(F.regexp_like(c, F.lit(f"(?is){rx}")), F.named_struct(F.lit("kind"), F.lit(k), F.lit("before"), _before_sinks(c, rx, width), F.lit("after"), _after_sinks(c, k, width))) for k, rx in SINKS.items()]
        return F.array_compact(F.array(*cells))

    return let(_longest_name(assignments(c) if items is None else items), windows)


def _within(name: Column, w: Column) -> Column:
    """The name stands whole within reach of a sink, in either order."""
    reach, low = F.length(name) + FLOW_REACH, F.lower(name)
    return F.exists(w["before"], lambda t: F.lower(F.right(t, reach)).contains(low)) | F.exists(w["after"], lambda t: F.lower(F.left(t, reach)).contains(low))


def flow_signals(files: DataFrame, seeds: DataFrame, reached: DataFrame) -> DataFrame:
    """Signals per file: decoded text or variables (direct and propagated) near an exec, network or command sink.

    ``files`` carries content and preprocessed.  One scan finds the sinks of a file and cuts the text within
    their reach; variables are joined to these windows, never to contents, and looked up as plain text.
    """
    joined = F.lower(F.concat_ws("\n", "content", "preprocessed"))
    f = files.select("skill_id", "path", "content", _assignments_of(files).alias("_assignments"), joined.alias("_j")).where(has_any(F.col("_j"), DECODED_MARKERS))
    whole = F.array_compact(F.array(*[F.when(has_any(F.col("_j"), w), F.lit(f"decoded result near {s}")) for s, w in RESULT_WORDS.items()]))
    cut = f.select("skill_id", "path", bound(whole).alias("whole"), bound(sink_windows(F.col("content"), F.col("_assignments"))).alias("windows"))
    names = seeds.select("skill_id", "path", "name", F.lit("decoded variable near ").alias("label")).unionByName(reached.select("skill_id", "path", "name", F.lit("decoded variable propagated near ").alias("label")))
    per_file = names.distinct().groupBy("skill_id", "path").agg(F.collect_list(F.struct("label", "name")).alias("names"))  # bounded by the file's own variables
    hits = F.flatten(F.transform("windows", lambda w: F.transform(F.filter("names", lambda n: _within(n["name"], w)), lambda n: F.concat(n["label"], w["kind"]))))
    out = cut.join(per_file, ["skill_id", "path"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<struct<label:string,name:string>>")))
    # bound, so that the generator's test for an empty list does not repeat the search
    found = out.select("skill_id", "path", bound(F.array_distinct(F.concat("whole", hits))).alias("signals"))
    return found.select("skill_id", "path", F.explode("signals").alias("signal"))


def obfuscation_evidence(files: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per file with recovered text: technique list, number of sections, what an analysis noted, signals.

    External analyses may supply technique / confidence / summary / decoded lines and benign / risk lists inside
    ``preprocessed``; their section stands last, so the last line of a kind counts.
    """
    sig = signals.groupBy("skill_id", "path").agg(F.array_join(F.sort_array(F.collect_set("signal")), ";").alias("signals"))  # nine labels at most
    pre = ws_trim(F.coalesce("preprocessed", F.lit("")))
    every = files.where(pre != "").select("skill_id", "path", bound(F.transform(F.split(pre, "\n", -1), ws_trim)).alias("_lines"))
    lines = F.filter("_lines", lambda l: l.rlike(r"^(base64|hex|charcode|template|variable)\["))
    last = lambda name: F.get(F.reverse(F.filter("_lines", lambda l: l.startswith(f"{name}: "))), F.lit(0))
    field = lambda name: ws_trim(F.substring(F.coalesce(last(name), F.lit("")), len(name) + 3, 1 << 30))
    items = lambda name: F.filter(F.transform(F.split(field(name), r"\|", -1), ws_trim), lambda x: x != "").alias(name)
    return every.select(
        "skill_id", "path", F.array_join(F.array_sort(F.array_distinct(F.transform(lines, lambda l: F.regexp_extract(l, r"^([a-z0-9]+)\[", 1)))), ",").alias("techniques"),
        F.size(lines).alias("n_sections"), *[field(n).alias(n) for n in ("technique", "confidence", "summary", "decoded")], items("benign"), items("risk"),
    ).join(sig, ["skill_id", "path"], "left").withColumn("signals", F.coalesce("signals", F.lit("")))


# Finding category -> flow kinds relevant to it.
FLOW_KINDS = {"execution": ["exec", "command"], "outbound": ["network"], "credential": ["network", "exec"], "evasion": ["exec"]}


def flow_chains(signals: DataFrame) -> DataFrame:
    """Signals classified into exec / network / command chains per finding category, distinct."""
    kind = F.regexp_extract("signal", r"near (\w+)$", 1)
    cats = F.array_compact(F.array(*[F.when(kind.isin(k), F.lit(c)) for c, k in FLOW_KINDS.items()]))
    return signals.select("skill_id", "path", F.concat(F.lit("obfuscation_"), kind, F.lit("_flow")).alias("kind"), "signal", F.explode(cats).alias("category")).dropDuplicates(
        ["skill_id", "path", "kind", "signal", "category"])


