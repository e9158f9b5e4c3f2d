"""Record layouts read and written by the operators."""

import re

FRAME = "struct<name: string, file: string, line: int, qualified_name: string, module: string, is_system: boolean>"
SAMPLE = f"struct<count: bigint, value_ns: bigint, frames: array<{FRAME}>>"
FRAME_FIELDS = ["name", "file", "line", "qualified_name", "module", "is_system"]
#: One line of an event log. ``_corrupt_record`` keeps what could not be read.
EVENT = (
    "type string, time string, service string, pod string, service_version string, period_ns bigint, duration_ns bigint, cpu double, "
    f"memory_bytes bigint, memory_peak_bytes bigint, count bigint, frames array<{FRAME}>, samples array<{SAMPLE}>, "
    "qualname string, file string, line int, status string"
)
EVENT_READ = EVENT + ", _corrupt_record string"

# Event types.
TRACE_TYPES = ["wall_trace", "cpu_trace"]
PROFILE_TYPES = ["wall_profile", "cpu_profile"]
CALL_TYPE = "function_call"
METADATA_TYPE = "profile_metadata"

RANGE = "struct<s: bigint, e: bigint>"
SYMBOL = (
    "def_id bigint, id string, name string, kind string, file string, line int, line_end int, byte_start bigint, byte_end bigint, parent string, "
    f"loc int, complexity int, nesting_depth int, parameter_count int, is_async boolean, loop_ranges array<{RANGE}>, await_ranges array<{RANGE}>"
)
REFERENCE = "file string, ref_ord bigint, name string, receiver string, line int, byte_offset bigint, in_symbol string, sql_literal string"
IMPORT = "file string, local_name string, module_path string, imported_name string, line int"


def pruned(columns: list[str], frame: list[str], before: str = "") -> str:
    """The layout of event lines with some columns only, and some fields of their frames; a reader given it reads no others."""
    types = dict(field.split(": ") for field in FRAME[len("struct<") : -1].split(", "))
    stack = f"array<struct<{', '.join(f'{f}: {types[f]}' for f in frame)}>>"
    nested = {"frames": stack, "samples": f"array<struct<count: bigint, frames: {stack}>>"}
    plain = dict(field.split(" ") for field in re.sub(r"array<.*?>>+, ", "_, ", EVENT).split(", ") if " " in field)
    return before + ", ".join(f"{c} {nested.get(c) or plain[c]}" for c in columns)
