"""Texts for people: a report a file, and the index of a directory. All that comes in is bounded by columns and values shown."""

from __future__ import annotations

import datetime

from ..settings import DRAFTS, LEAST_COVERAGE, MARKDOWN, REPORTS, SINGLE_VALUE_SHARE


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def number_text(x: float | None) -> str:
    """5, not 5.0; no more digits than six where it is no whole number."""
    if x is None:
        return "-"
    return f"{int(x):,}" if float(x).is_integer() and abs(x) < 2**53 else f"{x:,.6g}"


def shortened(value: str, limit: int) -> str:
    quoted = repr(value)
    return quoted if len(quoted) <= limit else quoted[: limit - 1] + "…"


def _grid(heads: list[str], rows: list[list[str]], indent: str = "  ") -> list[str]:
    """Columns as wide as their widest cell; the first on the left, the others on the right."""
    widths = [max(len(r[k]) for r in [heads, *rows]) for k in range(len(heads))]
    line = lambda r: indent + "  ".join(c.ljust(w) if k == 0 else c.rjust(w) for k, (c, w) in enumerate(zip(r, widths, strict=True)))
    return [line(heads), indent + "-" * (sum(widths) + 2 * len(widths) - 2), *map(line, rows)]


def file_report(file: dict, columns: list[dict], concerns: list[dict] | None, shown: int) -> str:
    """file: path, size, rows, scope, seconds; columns: profile rows with `top`, a list of (value, n), and `coverage`."""
    out = [file["path"], f"  {size_text(file['size'])} on disk  |  {len(columns)} columns  |  {file['rows']:,} rows read  |  {file.get('seconds', 0)}s", f"  {file['scope']}", ""]
    if concerns is not None:
        out += ["  COLUMNS WORTH CHECKING BEFORE SHARING" if concerns else "  no columns matched the watch list and none look like paths"]
        for c in concerns:
            why = [f"name matched: {', '.join(c['matched_words'])}"] if c["matched_words"] else []
            why += [f"{1 - c['all_digit_share']:.0%} of values contain letters"] if c["all_digit_share"] < 1 else []
            why += [f"{c['path_like_share']:.0%} look like paths"] if c["path_like_share"] > 0 else []
            out += [f"    {c['column_name']}  {c['verdict']}", f"      {'; '.join(why)}", f"      e.g. {c.get('example', '')[:60]!r}"]
        out.append("")
    rows = []
    for c in columns:
        top = c["top"][0] if c["top"] else None
        distinct = f"{c['distinct_count']:,}" + "+" * c["distinct_count_is_at_least"]
        rows.append([
            c["column_name"], f"{c['empty_count']:,}", f"{c['null_like_text_count']:,}", distinct, str(c["shortest_value_length"] or "-"), str(c["longest_value_length"] or "-"),
            shortened(top[0], 28) if top else "-", f"{top[1] / c['filled_in_count']:.1%}" if top else "-",
        ])
    out += _grid(["column", "empty", "NA-ish", "distinct", "shortest", "longest", "most common value", "share"], rows)
    empty, constant = [c for c in columns if c["is_all_empty"]], [c for c in columns if c["holds_one_value"] and not c["is_all_empty"]]
    if empty or constant:
        out += ["", "  COLUMNS CARRYING NO INFORMATION"]
    if empty:
        out += ["", f"    empty in every row ({len(empty)})", *(f"      {c['column_name']}" for c in empty)]
    if constant:
        out += ["", f"    one value covers at least {SINGLE_VALUE_SHARE:.0%} of rows ({len(constant)})"]
        for c in constant:
            other = c["rows_seen"] - c["top_count"]
            note = f"   ({other:,} of {c['rows_seen']:,} rows differ)" if other else ""
            out.append(f"      {c['column_name']}  {shortened(c['top'][0][0], 30)}  {c['single_value_share']:.1%}{note}")
    if numeric := [c for c in columns if c["number_count"]]:
        figures = [[c["column_name"], f"{c['number_count']:,}", f"{c['not_a_number_count']:,}", number_text(c["smallest_number"]), number_text(c["largest_number"])] for c in numeric]
        out += ["", "  numbers", *_grid(["column", "numbers", "not numbers", "smallest", "largest"], figures)]
    out += ["", f"  most common values (up to {shown} per column)"]
    tails = []
    for c in columns:
        if not c["top"]:
            out += ["", f"    {c['column_name']}: (no values -- every row was empty)"]
            continue
        distinct = f"{c['distinct_count']:,} {'or more ' if c['distinct_count_is_at_least'] else ''}distinct"
        if c["coverage"] < LEAST_COVERAGE:
            value, n = c["top"][0]
            tails.append(f"    {c['column_name']}  ({distinct}) -- list suppressed, top {len(c['top'])} cover only {c['coverage']:.1%} of rows; most common {shortened(value, 30)} at {n / c['filled_in_count']:.1%}")
            continue
        out += ["", f"    {c['column_name']}  ({distinct})", *(f"      {shortened(v, 40):<42} {n:>12,}  {n / c['filled_in_count']:>6.1%}" for v, n in c["top"])]
    if tails:
        out += ["", f"  columns whose values do not repeat enough to list (under {LEAST_COVERAGE:.0%} coverage)", *tails]
    return "\n".join(out) + "\n"


def index(directory: str, outcomes: list[dict], others: list[dict], scope: str, now: datetime.datetime | None = None) -> str:
    """Every file of the directory, whatever became of it."""
    at = (now or datetime.datetime.now().astimezone()).isoformat(timespec="seconds")
    out = ["# FILES OF A DIRECTORY", "", f"Directory: {directory}", f"Read at:   {at}", f"Extent:    {scope}", "", f"# CSV files ({len(outcomes)})", ""]
    for o in outcomes:
        out.append(f"  {o['name']}  ({size_text(o['size'])})")
        if o["status"] == "failed":
            out += [f"      COULD NOT READ: {o['problem']}", f"      details in {o['stem']}.txt", ""]
            continue
        counts = f"{o['rows']:,} rows, {o['columns']} columns" if o["rows"] is not None else "rows and columns not known"
        out.append(f"      SKIPPED -- already documented. {counts}, from the previous run ({o['scope']})" if o["status"] == "skipped" else f"      {counts} read -- {o['scope']}")
        if o["columns_to_check"]:
            out.append(f"      check before sharing: {', '.join(o['columns_to_check'])}")
        elif o.get("check_results_unknown"):
            out.append("      check before sharing: NOT KNOWN -- the previous run did not record it; read this file again to find out")
        for title, names in (("empty in every row", o["empty_columns"]), (f"one value covers {SINGLE_VALUE_SHARE:.0%}+ of rows", o["constant_columns"])):
            if names:
                out.append(f"      {title} ({len(names)}): {', '.join(names)}")
        out.append(f"      described in {REPORTS}/{o['stem']}.txt")
        if o.get("drafted"):
            out += [f"      draft metadata: {DRAFTS}/{o['stem']}.draft.json -- NOT REVIEWED, fails validation on purpose", f"      rendered as: {MARKDOWN}/{o['stem']}.draft.md"]
        if o.get("draft_problem"):
            out.append(f"      draft NOT written: {o['draft_problem']}")
        out.append("")
    out += [] if outcomes else ["  (none)", ""]
    out += [f"# Other files, not examined ({len(others)})", ""]
    out += [f"  {o['name']}  ({size_text(o['size'])})  {o['reason']}" for o in others] or ["  (none)"]
    return "\n".join(out) + "\n"
