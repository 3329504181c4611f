"""Plain reports of scans and checks. They only lay out what a result's dictionary holds."""

from __future__ import annotations

COLOURS = {"ERROR": "31", "WARN": "33", "INFO": "36", "golden": "32", "warned": "33", "broken": "31"}


def painted(text: str, kind: str, colour: bool) -> str:
    return f"\x1b[{COLOURS[kind]}m{text}\x1b[0m" if colour and kind in COLOURS else text


def _finding(f: dict, colour: bool) -> str:
    what = f"{f['locus']}" + (f": expected {f['expected']}" if f["expected"] is not None else "") + (f", found {f['found']}" if f["found"] is not None else "")
    return f"    {painted(f['severity'], f['severity'], colour)} {f['reason_code']} {what}\n      {f['explanation']}"


def _accounting(a: dict) -> str:
    return f"{a['files_seen']} files: {a['profiled']} profiled, {a['degraded']} degraded, {a['catalogued']} catalogued, {a['refused']} refused"


def of_scan(result: dict, colour: bool = False) -> str:
    out = [f"Scan of {result['path_expression']}", _accounting(result["accounting"]) + f" in {result['elapsed_ms']:.0f} ms"]
    for f in result["families"]:
        out.append(f"  {f['family_id']}: {f['file_count']} file(s), {f['column_count']} columns, {f['type_variants']} type variant(s): {', '.join(f['representative_columns'][:12])}")
    out += ["Fileset:"] * bool(result["scan_findings"]) + [_finding(f, colour) for f in result["scan_findings"]]
    for v in result["file_verdicts"]:
        if v["findings"]:
            out += [f"  {v['path']} ({v['verdict']})", *[_finding(f, colour) for f in v["findings"]]]
    return "\n".join(out)


def of_check(result: dict, colour: bool = False) -> str:
    out = [f"Check of {result['path_expression']} against {result['baseline_source']} by {result['alignment_mode']}, extra columns {result['extra_column_policy']}", _accounting(result["accounting"]) + f" in {result['elapsed_ms']:.0f} ms"]
    out.append(", ".join(painted(f"{len(result[k])} {k}", k, colour) for k in ("golden", "warned", "broken")))
    out += [_finding(f, colour) for f in result["scan_findings"]]
    for k in ("broken", "warned"):
        for v in result[k]:
            out += [f"  {painted(k, k, colour)} {v['path']}: {v['explanation']}", *[_finding(f, colour) for f in v["findings"]]]
    return "\n".join(out)
