"""Repairs as edits.

An edit says what becomes of one line: it is replaced or deleted as a whole,
text goes in front of it, or spans of its characters are replaced. A finding's
edits are told from the original lines next to it, so a patch is as small as
its finding, and no text of a file is ever repeated per finding.

Edits of many findings are merged per line: equal ones count once, spans are
sorted by position and a span that overlaps an earlier one is a conflict, as is
anything on a line that is replaced as a whole. A file's text is put together
once, from the slices between its edited lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.functions.arrays import built_once, explode_once, let
from fleetlint.model import MIN_PROPOSAL_CONFIDENCE_PCT, MIT_TEXT, RULES
from fleetlint.session import materialise

# Rule -> edit, in the order the edits are applied to one line.
LINE_FIXES = {
    "DEP-DEPR": "replace requirement",
    "DEP-UNPIN": "replace requirement",
    "ML-LEAK-PREFIT": "move fit below split",
    "ML-VAL-NOSEED": "add random_state",
    "ML-MET-NOSTRAT": "add stratify",
    "QUAL-EXC": "log exception",
    "QUAL-MUT": "default to None",
    "SEC-YAML": "safe_load",
    "SEC-EXEC": "literal_eval",
}
CREATE_FIXES = {
    "ARCH-INIT": "create file",
    "DOC-NOREADME": "create file",
    "DOC-NOLICENSE": "create file",
    "CICD-NOWORKFLOWS": "create file",
    "DEPLOY-NODOCKER": "create file",
    "DEPLOY-NOGITIGNORE": "create file",
}
FIX_RULES = [*LINE_FIXES, *CREATE_FIXES]

# Text of created files; {repo} stands for the repository name.
FILE_TEMPLATES = {
    "DEPLOY-NOGITIGNORE": "# secrets and settings of one machine\n.env\n\n# made by Python\n.venv\n__pycache__\n",
    "CICD-NOWORKFLOWS": (
        "name: checks\non:\n  pull_request:\n  push:\n\njobs:\n  suite:\n    runs-on: ubuntu-24.04\n    steps:\n"
        "      - uses: actions/checkout@v4\n"
        "      - name: Requirements\n        if: hashFiles('requirements.txt') != ''\n"
        "        run: python3 -m pip install --requirement requirements.txt\n"
        "      - name: Suite\n        run: |\n          python3 -m pip install pytest\n          python3 -m pytest\n"
    ),
    "DOC-NOREADME": (
        "# {repo}\n\nWhat this project does, in a sentence or two.\n\n## Installation\n\n"
        "```bash\npip install -r requirements.txt\n```\n\n## Usage\n\nA first example:\n\n"
        "```bash\npython main.py\n```\n\n## Tests\n\n```bash\npytest\n```\n"
    ),
    "DOC-NOLICENSE": MIT_TEXT.replace("{holder}", "the authors of {repo}"),
    "ARCH-INIT": '"""Package marker."""\n',
    "DEPLOY-NODOCKER": (
        "FROM python:3.12-slim\nRUN useradd --create-home worker\nUSER worker\nWORKDIR /home/worker\n"
        "COPY --chown=worker . .\nRUN python -m pip install --user --requirement requirements.txt\n"
        "ENTRYPOINT [\"python\"]\n"
    ),
}

# ---- fixed patterns: three-line block of scaler, fit_transform and split; an
# empty mutable default.
SPLIT_BLOCK = (
    r"^([ \t]*)(scaler\s*=\s*[A-Za-z0-9_]+\(\))\n"
    r"[ \t]*([A-Za-z0-9_]+)\s*=\s*scaler\.fit_transform\(\3\)\n"
    r"([ \t]*)([A-Za-z0-9_, ]+)\s*=\s*train_test_split\(([^)]+)\)([^\n]*)"
)
EVAL_CALL = r"(?<![\w.])eval\("
EMPTY_DEFAULT = r"([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(\[\]|\{\}|set\(\))"
# ----

SPANS_TYPE = "array<struct<start:int,stop:int,ord:int,text:string>>"
EDITS_TYPE = f"array<struct<line_no:int,old_text:string,before:string,whole:boolean,text:string,spans:{SPANS_TYPE}>>"
#: Lines read for a block before the rest of the file is.
BLOCK_WINDOWS = (3, 12, 96, 768)
_ORD = {rule: k for k, rule in enumerate(LINE_FIXES)}


def fix_dim(spark: SparkSession) -> DataFrame:
    """Which edit each auto-fixable rule gets, if any; 37 rows at most."""
    rows = [
        (r.rule_id, {**LINE_FIXES, **CREATE_FIXES}.get(r.rule_id)) for r in RULES if r.auto_fixable
    ]
    return spark.createDataFrame(rows, "rule_id string, edit string")


def _leading(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\s*)", 1)


# ------------------------------------------------------------ the edits of a finding
def _edit(line_no: Column, old: Column, text: Column | None = None, spans: list[Column] | Column | None = None,
          before: Column | None = None, whole: bool = False) -> Column:
    given = F.array() if spans is None else spans if isinstance(spans, Column) else F.filter(
        F.array(*spans), lambda s: s.isNotNull())
    none = F.lit(None).cast("string")
    return F.struct(
        line_no.alias("line_no"), old.alias("old_text"), (none if before is None else before).alias("before"),
        F.lit(whole).alias("whole"), (none if text is None else text).alias("text"), given.cast(SPANS_TYPE).alias("spans"))


def _replaced(line_no: Column, old: Column, text: Column | None) -> Column:
    """A line replaced as a whole; deleted without a text."""
    return _edit(line_no, old, text, whole=True)


def _span(start: Column, stop: Column, rule: str, text: Column) -> Column:
    return F.struct(start.alias("start"), stop.alias("stop"), F.lit(_ORD[rule]).alias("ord"), text.alias("text"))


def _only(condition: Column, *edits: Column) -> Column:
    return F.when(condition, F.array(*edits).cast(EDITS_TYPE)).otherwise(F.array().cast(EDITS_TYPE))


def _trimmed(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+$", ""))


def _before_last_paren(text: Column, rule: str, extra: str, bare: str | None = None) -> list[Column]:
    """An argument goes before the last closing parenthesis, white space there is removed."""
    head = F.regexp_extract(text, r"^(.*)\)[^)]*$", 1)
    at = _trimmed(head)
    empty = F.substring(head, at, F.lit(1)) == "("
    added = F.when(empty, F.lit(bare)).otherwise(F.lit(extra)) if bare else F.lit(extra)
    return [_span(at, at, rule, added), F.when(F.length(head) > at, _span(at, F.length(head), rule, F.lit("")))]


def _starts(text: Column, pattern: str, width) -> Column:
    """Where each match of a pattern begins; ``width`` gives the length of the k-th."""
    gaps = F.split(text, pattern, -1)
    widths = F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda k: width(k - 1))

    def total(array, n):
        return F.aggregate(F.slice(array, F.lit(1), n), F.lit(0), lambda acc, x: acc + x)

    lengths = F.transform(gaps, F.length)
    return F.when(F.size(gaps) > 1, F.transform(
        F.sequence(F.lit(1), F.size(gaps) - 1), lambda k: total(lengths, k) + total(widths, k - 1)
    )).otherwise(F.array().cast("array<int>"))


def _inserted(text: Column, pattern: str, width: int, offset: int, rule: str, added: str) -> Column:
    """The same text at an offset into every match of a fixed length."""
    return F.transform(
        _starts(text, pattern, lambda k: F.lit(width)), lambda at: _span(at + offset, at + offset, rule, F.lit(added)))


def _none_defaults(n: Column, text: Column) -> Column:
    """All empty defaults of a def line become None, guards follow below it."""
    rule = "QUAL-MUT"
    indent = F.concat(_leading(text), F.lit("    "))
    found = {k: F.regexp_extract_all(text, F.lit(EMPTY_DEFAULT), F.lit(k)) for k in (0, 1, 2)}
    starts = _starts(text, EMPTY_DEFAULT, lambda k: F.length(F.coalesce(F.get(found[0], k), F.lit(""))))
    spans = F.transform(starts, lambda at, k: _span(
        at + F.length(F.get(found[1], k)), at + F.length(F.get(found[0], k)), rule, F.lit("=None")))
    guards = F.transform(F.arrays_zip(found[1].alias("arg"), found[2].alias("value")), lambda p: F.concat(
        F.lit("\n"), indent, F.lit("if "), p.arg, F.lit(" is None:\n"),
        indent, F.lit("    "), p.arg, F.lit(" = "), p.value))
    below = _span(F.length(text), F.length(text), rule, F.array_join(guards, ""))
    return _only(text.rlike(EMPTY_DEFAULT), _edit(n, text, spans=F.concat(spans, F.array(below))))


def _block_text(lines: Column, n: Column) -> Column:
    """The scaler / fit_transform / split block whose second line is ``n``, or null. The windows grow, so
    that a short block costs no more than itself."""
    able = (n > 1) & F.get(lines, n - 1).rlike(r"scaler\.fit_transform\(") & F.get(lines, n - 2).rlike(r"^[ \t]*scaler\s*=")

    def seen(sizes):
        if not sizes:
            return F.lit(None).cast("string")
        window = F.array_join(F.slice(lines, F.greatest(n - 1, F.lit(1)), sizes[0]), "\n")
        return let(window, lambda w: F.when(w.rlike(SPLIT_BLOCK), F.regexp_extract(w, SPLIT_BLOCK, 0)).otherwise(seen(sizes[1:])))

    return F.when(able, seen([*map(F.lit, BLOCK_WINDOWS), F.size(lines)]))


def _moved_block(lines: Column, n: Column, block: Column) -> Column:
    """The split goes first; scaler and fit follow below it on the training part."""
    rule = "ML-LEAK-PREFIT"

    def group(k):
        return F.regexp_extract(block, SPLIT_BLOCK, k)

    head = F.concat(group(1), tx.strip(group(5)), F.lit(" = train_test_split("))
    tail = F.concat(
        F.lit("\n"), group(1), group(2), F.lit("\n"), group(1), F.lit("X_train = scaler.fit_transform(X_train)\n"),
        group(1), F.lit("X_test = scaler.transform(X_test)"))
    args = group(6)
    seeded = F.contains(args, F.lit("random_state"))
    gone = [_replaced(n - 1, F.get(lines, n - 2), None), _replaced(n, F.get(lines, n - 1), None)]
    split = F.get(lines, n)
    opened = F.length(F.regexp_extract(split, r"^([ \t]*[A-Za-z0-9_, ]+\s*=\s*train_test_split\()", 1))
    led = F.length(args) - F.length(F.regexp_replace(args, r"^\s+", ""))
    end = opened + _trimmed(args)
    spans = [
        _span(F.lit(0), opened, rule, head),
        F.when(~seeded & (led > 0), _span(opened, opened + led, rule, F.lit(""))),
        F.when(~seeded, _span(end, end, rule, F.lit(", random_state=42"))),
        F.when(~seeded & (opened + F.length(args) > end), _span(end, opened + F.length(args), rule, F.lit(""))),
        _span(F.length(split), F.length(split), rule, tail),
    ]
    size = F.size(F.split(block, "\n", -1))
    one_line = F.array(*gone, _edit(n + 1, split, spans=spans)).cast(EDITS_TYPE)
    whole = F.concat(
        head, F.when(seeded, args).otherwise(F.concat(tx.strip(args), F.lit(", random_state=42"))), F.lit(")"), group(7), tail)
    rest = F.transform(F.sequence(n + 2, n + size - 2), lambda k: _replaced(k, F.get(lines, k - 1), None)).cast(EDITS_TYPE)
    return F.when(size == 3, one_line).otherwise(
        F.concat(F.array(*gone, _replaced(n + 1, split, whole)).cast(EDITS_TYPE), rest))


def _edits_of(h: Column, lines: Column, original: Column) -> Column:
    """The edits of one hit, from the lines next to it."""
    n, rule = h.line_no, h.rule_id
    line, below = F.get(lines, n - 1), F.get(lines, n)
    closing = F.contains(line, F.lit(")"))

    def pinned():
        return F.array(_replaced(n, line, h.detail)).cast(EDITS_TYPE)

    def unfitted():
        comment = _span(F.lit(0), F.lit(0), "ML-LEAK-PREFIT", F.lit("# fitted after the split instead\n# "))
        alone = _only(F.contains(line, F.lit("fit_transform")), _edit(n, line, spans=[comment]))
        return let(_block_text(lines, n), lambda block: F.when(block.isNull(), alone).otherwise(_moved_block(lines, n, block)))

    def seeded():
        able = F.contains(line, h.detail) & ~F.contains(line, F.lit("random_state")) & closing
        return _only(able, _edit(n, line, spans=_before_last_paren(
            line, "ML-VAL-NOSEED", ", random_state=42", "random_state=42")))

    def stratified():
        able = F.contains(line, F.lit("train_test_split")) & ~F.contains(line, F.lit("stratify")) & closing
        return _only(able, _edit(n, line, spans=_before_last_paren(line, "ML-MET-NOSTRAT", ", stratify=y")))

    def logged():
        indent = _leading(line)
        return _only(
            F.coalesce(F.contains(below, F.lit("pass")), F.lit(False)),
            _replaced(n, line, F.concat(indent, F.lit("except Exception as err:"))),
            _replaced(n + 1, below, F.concat(
                indent, F.lit("    import logging\n"), indent,
                F.lit('    logging.getLogger(__name__).warning("suppressed: %s", err)'))))

    def safe_load():
        return _only(F.contains(line, F.lit("yaml.load(")), _edit(
            n, line, spans=_inserted(line, r"yaml\.load\(", 10, 5, "SEC-YAML", "safe_")))

    def literal():
        spans = _inserted(line, EVAL_CALL, 5, 0, "SEC-EXEC", "ast.literal_")
        first = F.lit("import ast\n")
        imported = F.contains(original, F.lit("import ast"))
        able = ~F.contains(original, F.lit("ast.literal_eval")) & line.rlike(EVAL_CALL)
        here = F.when(~imported & (n == 1), first)
        return F.concat(
            _only(able & ~imported & (n > 1), _edit(F.lit(1), F.get(lines, F.lit(0)), before=first)),
            _only(able, _edit(n, line, spans=spans, before=here)))

    made = F.when(rule.isin("DEP-DEPR", "DEP-UNPIN"), pinned())
    for rule_id, build in {
        "ML-LEAK-PREFIT": unfitted, "ML-VAL-NOSEED": seeded, "ML-MET-NOSTRAT": stratified, "QUAL-EXC": logged,
        "QUAL-MUT": lambda: _none_defaults(n, line), "SEC-YAML": safe_load, "SEC-EXEC": literal,
    }.items():
        made = made.when(rule == rule_id, build())
    return F.filter(made, lambda e: ~e.old_text.eqNullSafe(new_text(e)))


# ------------------------------------------------------------ one line's new text
def clean_spans(spans: Column) -> Column:
    """Spans by position and rule, equal ones once, without those that overlap an earlier one."""
    def last(acc):
        return F.coalesce(F.get(acc, F.size(acc) - 1).stop, F.lit(0))

    def known(acc, s):
        return F.exists(acc, lambda k: (k.start == s.start) & (k.stop == s.stop) & (k.text == s.text))

    return F.aggregate(
        F.array_sort(spans), F.array().cast(SPANS_TYPE),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (known(acc, s) | (s.start < last(acc))), acc
        ).otherwise(F.concat(acc, F.array(s))))


def _spliced(old: Column, spans: Column) -> Column:
    def before(s, k):
        start = F.coalesce(F.get(spans, k - 1).stop, F.lit(0))
        return F.concat(F.substring(old, start + 1, s.start - start), s.text)

    end = F.coalesce(F.get(spans, F.size(spans) - 1).stop, F.lit(0))
    return F.concat(F.array_join(F.transform(spans, before), ""), F.substring(old, end + 1, F.length(old)))


def new_text(e: Column) -> Column:
    """What becomes of the line; null if it is deleted."""
    body = F.when(e.whole, e.text).otherwise(let(clean_spans(e.spans), lambda spans: _spliced(e.old_text, spans)))
    return F.when(e.before.isNull(), body).otherwise(F.coalesce(F.concat(e.before, body), F.rtrim(e.before, F.lit("\n"))))


def changed(edits: Column) -> Column:
    """Changed lines with old and new text; null new text is a deletion."""
    return F.transform(edits, lambda e: F.struct(
        e.line_no.alias("line_no"), e.old_text.alias("old_text"), new_text(e).alias("new_text")))


def merged_lines(edits: DataFrame) -> DataFrame:
    """One row per edited line, with all that findings do to it.

    ``edits`` has a row ``(repo_id, path, finding_id, edit)`` per edit. A hot
    file is no hot key, as lines are the groups. ``conflicts`` counts the
    findings of which something on the line is left out: another replaces the
    line as a whole, or a span overlaps an earlier one.
    """
    e = F.col("edit")
    lines = edits.groupBy("repo_id", "path", e.line_no.alias("line_no")).agg(
        F.min(e.old_text).alias("old_text"), F.max(e.before).alias("before"), F.bool_or(e.whole).alias("whole"),
        F.min(F.when(e.whole, F.struct("finding_id", e.text.alias("text")))).alias("first"),
        F.flatten(F.collect_list(F.when(~e.whole, e.spans))).alias("spans"),
        F.sort_array(F.collect_list(F.struct("finding_id", e.whole.alias("whole"), e.text.alias("text"), e.spans.alias("spans")))).alias("given"))
    comment, seed = _ORD["ML-LEAK-PREFIT"], _ORD["ML-VAL-NOSEED"]
    # A line that is commented out needs no seed.
    commented = F.exists("spans", lambda s: (s.ord == comment) & (s.start == 0) & (s.stop == 0))
    kept = clean_spans(F.when(commented, F.filter("spans", lambda s: s.ord != seed)).otherwise(F.col("spans")))
    lines = lines.withColumns({"text": F.col("first.text"), "spans": kept})

    def left_out(g):
        lost = F.exists(g.spans, lambda s: ~F.exists("spans", lambda k: (
            (k.start == s.start) & (k.stop == s.stop) & (k.text == s.text))))
        return F.when(F.col("whole"), ~g.whole & (F.size(g.spans) > 0) | g.whole & ~g.text.eqNullSafe(F.col("text"))).otherwise(lost)

    return lines.select(
        "repo_id", "path", "line_no", "old_text",
        new_text(F.struct("old_text", "before", "whole", "text", "spans")).alias("new_text"),
        F.transform(F.filter("given", left_out), lambda g: g.finding_id).alias("conflicts"))


def rebuilt(lines: Column, edits: Column) -> Column:
    """A file's text from the slices between its edited lines; ``edits`` are ``(line_no, new_text)``, sorted."""
    def part(e, k):
        start = F.coalesce(F.get(edits, k - 1).line_no, F.lit(0))
        return F.concat(
            F.slice(lines, start + 1, e.line_no - start - 1),
            F.when(e.new_text.isNull(), F.array().cast("array<string>")).otherwise(F.array(e.new_text)))

    last = F.coalesce(F.get(edits, F.size(edits) - 1).line_no, F.lit(0))
    rest = F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))
    return F.concat(F.array_join(F.concat(F.flatten(F.transform(edits, part)), rest), "\n"), F.lit("\n"))


def rebuilt_text(original: Column, edits: Column) -> Column:
    return let(tx.split_lines(original), lambda lines: let(edits, lambda es: rebuilt(lines, es)))


def hit_id(h) -> Column:
    return tx.stable_id(
        h.rule_id, F.col("repo_id").cast("string"), h.path, F.coalesce(h.line_no.cast("string"), F.lit("-")), h.disc
    )


# ------------------------------------------------------------ patches
def patched_files(annotated: DataFrame) -> DataFrame:
    """One row per file that some line fix applies to: its text and ``patches``, an array of
    ``(finding_id, rule_id, title, edits)``. ``annotated`` rows carry ``hits`` and ``original``, as scanned for repair."""
    return annotated.filter("original is not null").select(
        "repo_id", "repo_name", "path", "original", _file_patches().alias("patches"))


@built_once
def _file_patches() -> Column:
    """The patches of a file, from its ``hits`` and ``original``."""
    def patch(h, lines):
        return F.struct(
            hit_id(h).alias("finding_id"), h.rule_id.alias("rule_id"), h.title.alias("title"),
            _edits_of(h, lines, F.col("original")).alias("edits"))

    fixable = F.filter("hits", lambda h: h.rule_id.isin(*LINE_FIXES))
    made = let(tx.split_lines(F.col("original")), lambda lines: F.transform(fixable, lambda h: patch(h, lines)))
    return F.filter(made, lambda p: F.size(p.edits) > 0)


def line_patches(patched: DataFrame) -> DataFrame:
    """One patch per finding that has a line fix, from ``patched_files``; it holds its edits, not the text."""
    found = explode_once(patched, ["repo_id", "path"], "patches", "p")
    return found.select(
        "repo_id", F.col("p.finding_id").alias("finding_id"), F.col("p.rule_id").alias("rule_id"), "path",
        F.concat(F.lit("Auto-repair: "), F.col("p.title")).alias("description"),
        F.lit(None).cast("string").alias("replacement_code"), F.col("p.edits").alias("edits"))


def template_dim(spark: SparkSession) -> DataFrame:
    """Six file templates."""
    return spark.createDataFrame(list(FILE_TEMPLATES.items()), "rule_id string, template string")


def create_patches(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Patches that add a missing file."""
    wanted = findings.filter(F.col("rule_id").isin(*CREATE_FIXES))
    named = wanted.join(repos.select("repo_id", "repo_name"), "repo_id")
    spark = findings.sparkSession
    return named.join(F.broadcast(template_dim(spark)), "rule_id").select(
        "repo_id", "finding_id", "rule_id", "path",
        F.concat(F.lit("Create "), F.col("path")).alias("description"),
        F.replace("template", F.lit("{repo}"), F.col("repo_name")).alias("replacement_code"),
        F.array().cast(EDITS_TYPE).alias("edits"),
    )


def accepted_proposals(proposals: DataFrame, findings: DataFrame) -> DataFrame:
    """Safe, confident, non-empty proposals for auto-fixable findings; proposals
    for unknown findings fall away in the join."""
    good = proposals.filter(
        F.col("safe_to_apply")
        & (F.round(F.col("confidence") * 100) >= MIN_PROPOSAL_CONFIDENCE_PCT)
        & (F.coalesce(F.length("replacement_code"), F.lit(0)) > 0)
    )
    known = findings.filter("auto_fixable").select("finding_id", "repo_id", "rule_id", "path", "title")
    return good.select("finding_id", "root_cause", "replacement_code").join(known, "finding_id")


def proposal_patches(accepted: DataFrame, files: DataFrame) -> DataFrame:
    """Patches from proposals, where the text differs from the file.

    Only length and digest of the files' texts meet the proposals: both are told
    where a file is read, so no text is shuffled.
    """
    marks = files.select(
        "repo_id", "path", F.octet_length("content").alias("size"), F.xxhash64("content").alias("digest"))
    same = (F.octet_length("replacement_code") == F.col("size")) & (F.xxhash64("replacement_code") == F.col("digest"))
    return accepted.join(marks, ["repo_id", "path"]).filter(~same).select(
        "repo_id", "finding_id", "rule_id", "path",
        tx.strip(F.concat(F.lit("Proposed repair: "), "title", F.lit(". "), F.coalesce("root_cause", F.lit(""))))
        .alias("description"),
        "replacement_code", F.array().cast(EDITS_TYPE).alias("edits"),
    )


def with_originals(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Whole-file patches with the text that they replace, empty for new files.

    The keys of proposals are few. They are written, so that the join with the
    files is planned by their size and does not shuffle all texts for them.
    """
    new = F.col("rule_id").isin(*CREATE_FIXES)
    proposed = patches.filter(~new)
    keys = materialise(proposed.select("repo_id", "path").distinct().coalesce(1), "proposal_keys")
    texts = files.join(keys, ["repo_id", "path"], "left_semi").select("repo_id", "path", F.col("content").alias("original_code"))
    return proposed.join(texts, ["repo_id", "path"], "left").fillna("", ["original_code"]).unionByName(
        patches.filter(new).withColumn("original_code", F.lit("")))


def override(patches: DataFrame, proposed: DataFrame) -> DataFrame:
    """A proposal replaces the built-in patch of its finding."""
    kept = patches.join(proposed.select("finding_id"), "finding_id", "left_anti")
    return kept.select(*patches.columns).unionByName(proposed)


def edit_rows(patches: DataFrame) -> DataFrame:
    """A row ``(repo_id, path, finding_id, edit)`` per edit."""
    return patches.select("repo_id", "path", "finding_id", F.explode("edits").alias("edit"))


def line_edits(patches: DataFrame) -> DataFrame:
    """Changed lines in long form."""
    flat = patches.select("repo_id", "path", "finding_id", "rule_id", F.inline(changed(F.col("edits"))))
    op = F.when(F.col("new_text").isNull(), "delete").otherwise("replace")
    return flat.withColumn("op", op)


def merged_files(patched: DataFrame, patches: DataFrame) -> DataFrame:
    """Files rebuilt with all edits of the given patches at once; a text is put together once."""
    lines = merged_lines(edit_rows(patches))
    by_file = lines.groupBy("repo_id", "path").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "new_text"))).alias("edits"))
    texts = patched.select("repo_id", "repo_name", "path", "original")
    return texts.join(by_file, ["repo_id", "path"]).select(
        "repo_id", "repo_name", "path", rebuilt_text(F.col("original"), F.col("edits")).alias("content"))
