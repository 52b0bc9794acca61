"""The rules by which solver logs are read."""

from __future__ import annotations

from tessera.operators.logs import Kind, Rule

# Triggers, phrases, severities and categories, in the order in which they are tried.
FATAL = r"(?i)FOAM FATAL|FOAM exiting|segmentation fault|sigsegv"
WARNING = r"(?i)FOAM Warning"
MISSING = r"cannot find required object\s+([a-z0-9_.+-]+)"
KINDS = [
    Kind(
        FATAL,
        5,
        (
            Rule("parallel_internal_patch_missing", "fatal", ("internal patch should be added",)),
            Rule("field_dictionary_type_mismatch", "fatal", ("expected a '('",)),
            Rule("field_dictionary_type_mismatch", "fatal", ('expected a "("',)),
            Rule("boundary_condition_missing_entry", "fatal", ("keyword gamma is undefined",)),
            Rule("postprocessing_missing_pressure_field", "fatal", ('was not found in "postprocessing/pressureprobes"',)),
            Rule("openfoam_fatal", "fatal"),
        ),
        blocking=True,
        cut_first=True,
    ),
    Kind(
        WARNING,
        8,
        (
            Rule("derived_field_unavailable", "nonblocking_warning", subjects=("dynamicp", "dynamicpressure", "overpressure", "impulse")),
            Rule("missing_runtime_object", "warning", subject=True),
            Rule("mesh_default_patch", "nonblocking_warning", ("undefined faces", "default patch")),
            Rule("probe_location_adjusted", "nonblocking_warning", ("blastprobes::findelements",)),
            Rule("probe_location_adjusted", "nonblocking_warning", ("blastprobes were not found",)),
            Rule("mesh_boundary_update", "nonblocking_warning", ("boundary changed, proceed with care",)),
            Rule("charge_mass_discretization", "warning", ("requested mass is", "set mass is")),
            Rule("blast_function_library_unavailable", "warning", ("libblastfunctionobject.so", "could not load")),
            Rule("probe_interpolation_downgraded", "nonblocking_warning", ("only cell interpolation can be applied",)),
            Rule("openfoam_warning", "warning"),
        ),
        subject=MISSING,
    ),
]


def verdict_sql(message: str, seen: list[str]) -> str:
    """A struct of severity and category by ``KINDS``, for the column ``kind`` and the texts that each kind's rules see."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    out = "CASE"
    for i, k in enumerate(KINDS):
        for r in k.rules:
            needs = [f"kind = {i}", *[f"contains({seen[i]}, {quoted(p)})" for p in r.phrases]]
            if r.subjects:
                needs.append(f"regexp_extract({seen[i]}, {quoted(k.subject)}, 1) IN ({', '.join(map(quoted, r.subjects))})")
            elif r.subject:
                needs.append(f"regexp_extract({seen[i]}, {quoted(k.subject)}, 1) <> ''")
            out += f" WHEN {' AND '.join(needs)} THEN {{'severity': {quoted(r.severity)}, 'category': {quoted(r.category)}, 'blocking': {str(k.blocking).lower()}}}"
    return out + " END"
