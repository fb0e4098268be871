"""Action contracts (T2, T4, T13): which JSON objects are valid decisions, their canonical form, and controlled edits of them.

A contract is a table of fields: kind, bounds, default, whether it is required. It is compiled into native checks on a variant column, and into the
normal form of an action (defaults filled in, strings trimmed, numbers of the field's kind, keys sorted). Values are read as leniently as
JSON clients write them: whole numbers also as decimals or digits in quotes, truth values also as 0, 1 or the usual words. Unknown fields,
missing ones, other types and values outside their bounds make an action invalid, at any depth.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.training_data import UNSAFE, json_object

# Identifiers, and the words for truth values.
IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9_.:-]*\\z"
TRUE_WORDS, FALSE_WORDS = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")


class Field(NamedTuple):
    kind: str  # id, text, int, float, bool, one, list, object, union
    required: bool = True
    default: Any = None  # a literal; a field with a null default may be null
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    item: Field | None = None
    fields: dict[str, Field] | None = None
    distinct: bool = False
    rule: Callable[[str], str] | None = None  # SQL of a condition on the normal form
    aliases: tuple[str, ...] = ()
    above: bool = False  # low itself is not allowed


def optional(f: Field, default: Any = None) -> Field:
    return f._replace(required=False, default=default)


def objects(fields: dict[str, Field], rule: Callable[[str], str] | None = None) -> Field:
    return Field("object", fields={**fields, "schema_version": Field("one", False, "1.0", values=("1.0",))}, rule=rule)


def many(item: Field, low: int = 0, high: int | None = None, distinct: bool = False, rule: Callable[[str], str] | None = None) -> Field:
    return Field("list", item=item, low=low, high=high, distinct=distinct, rule=rule)


def one(*values: str) -> Field:
    return Field("one", values=values)


def whole(low: int, high: int | None = None) -> Field:
    return Field("int", low=low, high=high)


ID, TEXT, BOOL = Field("id"), Field("text"), Field("bool")
_distinct = lambda xs: f"size(array_distinct({xs})) = size({xs})"
_in_order = lambda c: f"forall(sequence(1, greatest(1, size({c}) - 1)), i -> size({c}) < 2 OR {c}[i].time_range.start_ms >= {c}[i - 1].time_range.end_ms)"

# The tools and decisions, with their fields and bounds.
TIME_RANGE = objects({"start_ms": whole(0), "end_ms": Field("int", low=0, above=True)}, lambda t: f"{t}.start_ms < {t}.end_ms")
EVIDENCE = ("transcript", "ocr", "structured_text", "keyframe", "native_video_verification")
CUE = objects({"cue_id": ID, "time_range": TIME_RANGE, "text": TEXT}, lambda c: f"NOT contains({c}.text, char(0))")
STYLE = objects(
    {
        "font_size": optional(whole(8, 96), 24),
        "alignment": optional(one("bottom", "center", "top"), "bottom"),
        "text_color": optional(one("white", "yellow"), "white"),
        "outline_color": optional(one("black", "white"), "black"),
    }
)
TOOLS: dict[str, Field] = {
    "search_video": objects(
        {
            "query": TEXT,
            "top_k": optional(whole(1, 20), 5),
            "video_id": optional(ID),
            "approximate_time_range": optional(TIME_RANGE),
            "required_evidence_types": optional(many(one(*EVIDENCE), distinct=True), ()),
        }
    ),
    "inspect_media": objects({"input_artifact_id": ID}),
    "trim_video": objects({"input_artifact_id": ID, "time_range": TIME_RANGE}),
    "concat_videos": objects({"input_artifact_ids": many(ID, 2, 32, distinct=True)}),
    "change_speed": objects({"input_artifact_id": ID, "speed_factor": Field("float", low=0.24, high=4.0, above=True)}),
    "add_subtitles": objects(
        {"input_artifact_id": ID, "cues": many(CUE, 1, 500, rule=lambda c: f"{_distinct(f'transform({c}, q -> q.cue_id)')} AND {_in_order(c)}"), "style": optional(STYLE, {})}
    ),
    "reframe_video": objects(
        {"input_artifact_id": ID, "width": whole(64, 4096), "height": whole(64, 4096), "fit": optional(one("crop", "pad"), "crop")},
        lambda a: f"{a}.width % 2 = 0 AND {a}.height % 2 = 0",
    ),
    "normalize_audio": objects(
        {
            "input_artifact_id": ID,
            "target_lufs": optional(Field("float", low=-30.0, high=-5.0), -16.0),
            "loudness_range": optional(Field("float", low=1.0, high=20.0), 11.0),
            "true_peak_db": optional(Field("float", low=-9.0, high=0.0), -1.5),
        }
    ),
    "validate_media": objects({"input_artifact_id": ID, "require_audio": optional(BOOL, False), "decode_entire_video": optional(BOOL, True)}),
}
PLAN_STATUS = ("pending", "ready", "running", "succeeded", "failed", "blocked", "skipped")
PLAN_NODE = objects(
    {
        "node_id": ID._replace(aliases=("step_id",)),
        "subgoal": TEXT._replace(aliases=("description",)),
        "dependencies": optional(many(ID, distinct=True), ()),
        "status": optional(one(*PLAN_STATUS, "done"), "pending"),
        "expected_evidence": optional(many(TEXT), ()),
        "preferred_capability": optional(ID),
        "completion_criteria": optional(many(TEXT), ()),
    },
    lambda n: f"NOT array_contains({n}.dependencies, {n}.node_id)",
)
_steps_known = lambda s: f"{_distinct(f'{s}.node_id')} AND size(array_except(flatten({s}.dependencies), {s}.node_id)) = 0"
PLAN_PATCH = objects({"event_type": optional(one("plan_patch"), "plan_patch"), "revision": whole(1), "reason": TEXT, "steps": many(PLAN_NODE, rule=_steps_known)})
CALLS = {tool: objects({"tool_name": one(tool), "tool_call_id": ID, "arguments": arguments}) for tool, arguments in TOOLS.items()}
CONTRACTS: dict[str, dict[str, dict[str, Field]]] = {
    "policy_decision": {
        "decision_type": {
            **{
                f"tool/{tool}": objects({"decision_type": one("tool"), "tool_call": call, "rationale": TEXT, "expected_observation": TEXT, "success_condition": TEXT})
                for tool, call in CALLS.items()
            },
            "replan": objects({"decision_type": one("replan"), "reason": TEXT, "affected_plan_nodes": many(ID, 1, distinct=True), "requested_patch": PLAN_PATCH}),
            "finish": objects({"decision_type": one("finish"), "output_artifact_id": ID, "completion_summary": TEXT, "evidence_ids": many(ID, 1)}),
            "cannot_complete": objects(
                {"decision_type": one("cannot_complete"), "reason": TEXT, "missing_evidence_or_capability": many(TEXT, 1), "attempted_action_ids": optional(many(ID), ())}
            ),
        }
    },
    "recovery_decision": {
        "recovery_type": {
            "retry_current_node": objects({"recovery_type": one("retry_current_node"), "node_id": ID, "reason": TEXT, "preferred_capability": optional(ID)}),
            "modify_current_node": objects(
                {
                    "recovery_type": one("modify_current_node"),
                    "node_id": ID,
                    "reason": TEXT,
                    "revised_subgoal": TEXT,
                    "revised_completion_criteria": many(TEXT, 1, 8),
                    "preferred_capability": optional(ID),
                }
            ),
            "insert_recovery_node": objects(
                {
                    "recovery_type": one("insert_recovery_node"),
                    "affected_node_id": ID,
                    "reason": TEXT,
                    "recovery_subgoal": TEXT,
                    "completion_criteria": many(TEXT, 1, 8),
                    "preferred_capability": optional(ID),
                }
            ),
            "skip_blocked_node": objects({"recovery_type": one("skip_blocked_node"), "node_id": ID, "reason": TEXT}),
            "cannot_recover": objects({"recovery_type": one("cannot_recover"), "reason": TEXT, "missing_evidence_or_capability": many(TEXT, 1)}),
        }
    },
}


# Conditions and values are SQL texts, so that a contract is one expression for Spark to parse, and not thousands of column objects.
_fresh = count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """SQL of ``body(value)`` with the value computed once a row, however often the body names it."""
    x = f"x{next(_fresh)}"
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(v: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({v}, '{path}', '{kind}')"


def _kind(v: str, path: str) -> str:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID; null where there is nothing. Objects and lists have their own tests below, as this one
    would write out the schema of all that they hold."""
    return f"substring_index(schema_of_variant({_get(v, path)}), '(', 1)"


def _is_text(v: str, path: str) -> str:
    return f"schema_of_variant({_get(v, path)}) = 'STRING'"


def _is_object(v: str, path: str) -> str:
    return f"{_get(v, path, 'map<string,variant>')} IS NOT NULL"


def _is_list(v: str, path: str) -> str:
    return f"{_get(v, path, 'array<variant>')} IS NOT NULL"


def _trimmed(v: str, path: str) -> str:
    return f"regexp_replace({_get(v, path, 'string')}, r'(?U)^\\s+|\\s+\\z', '')"


def _has(v: str, path: str) -> str:
    return f"{_get(v, path)} IS NOT NULL"


def _words(values: tuple[str, ...]) -> str:
    return ", ".join(map(_text, values))


def _number(v: str, path: str) -> str:
    text, number = _trimmed(v, path), _get(v, path, "double")
    digits = f"CASE WHEN {text} RLIKE r'^[+-]?[0-9]+(\\.[0-9]*)?\\z' THEN try_cast({text} AS DOUBLE) END"
    boolean = f"CAST({_get(v, path, 'boolean')} AS DOUBLE)"
    return _let(_kind(v, path), lambda k: f"CASE WHEN {k} IN ('BIGINT', 'DECIMAL', 'DOUBLE') THEN {number} WHEN {k} = 'STRING' THEN {digits} WHEN {k} = 'BOOLEAN' THEN {boolean} END")


def _truth(v: str, path: str) -> str:
    word, number = f"lower({_get(v, path, 'string')})", _get(v, path, "double")
    said = f"CASE WHEN {word} IN ({_words(TRUE_WORDS)}) THEN true WHEN {word} IN ({_words(FALSE_WORDS)}) THEN false END"
    digit = f"CASE {number} WHEN 1 THEN true WHEN 0 THEN false END"
    boolean = _get(v, path, "boolean")
    return _let(_kind(v, path), lambda k: f"CASE WHEN {k} = 'BOOLEAN' THEN {boolean} WHEN {k} = 'STRING' THEN {said} WHEN {k} IN ('BIGINT', 'DECIMAL', 'DOUBLE') THEN {digit} END")


def _type(f: Field) -> str:
    if f.kind == "list":
        return f"array<{_type(f.item)}>"
    if f.kind == "object":
        return "struct<" + ",".join(f"{n}:{_type(x)}" for n, x in sorted(f.fields.items())) + ">"
    return {"int": "bigint", "float": "double", "bool": "boolean"}.get(f.kind, "string")


def _struct(parts: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in sorted(parts.items())) + ")"


def _default(f: Field) -> str:
    if f.kind == "list":
        return f"CAST(array() AS {_type(f)})"
    if f.kind == "object" and f.default is not None:
        return _struct({n: _default(x) for n, x in f.fields.items()})
    value = "NULL" if f.default is None else _text(f.default) if isinstance(f.default, str) else str(f.default).lower()
    return f"CAST({value} AS {_type(f)})"


def _normal(v: str, path: str, f: Field) -> str:
    """The value at ``path`` in its normal form: typed, trimmed, with defaults; null where it does not fit its kind."""
    if f.kind in ("id", "text"):
        return f"CASE WHEN {_is_text(v, path)} THEN {_trimmed(v, path)} END"
    if f.kind == "one":
        word = _get(v, path, "string")
        return f"CASE WHEN {_is_text(v, path)} THEN " + (f"CASE {word} WHEN 'done' THEN 'succeeded' ELSE {word} END" if "done" in f.values else word) + " END"
    if f.kind == "int":
        return f"CAST({_number(v, path)} AS BIGINT)"
    if f.kind == "float":
        return _number(v, path)
    if f.kind == "bool":
        return _truth(v, path)
    if f.kind == "list":
        x = f"x{next(_fresh)}"
        return f"transform({_get(v, path, 'array<variant>')}, {x} -> {_normal(x, '$', f.item)})"
    return f"CASE WHEN {_is_object(v, path)} THEN {_struct({n: _member(v, path, n, x) for n, x in f.fields.items()})} END"


def _member(v: str, path: str, name: str, f: Field) -> str:
    out = _normal(v, f"{path}.{name}", f)
    for a in f.aliases:
        out = f"CASE WHEN {_has(v, f'{path}.{name}')} THEN {out} ELSE {_normal(v, f'{path}.{a}', f)} END"
    return out if f.required else f"CASE WHEN {_has(v, f'{path}.{name}')} THEN {out} ELSE {_default(f)} END"


def _holds(v: str, path: str, f: Field) -> str:
    """Whether the value at ``path`` satisfies the field: never null."""
    if f.kind == "id":
        out = f"{_normal(v, path, f)} RLIKE r'{IDENTIFIER}'"
    elif f.kind == "text":
        out = f"{_is_text(v, path)} AND {_get(v, path, 'string')} RLIKE r'(?U)\\S'"
    elif f.kind == "one":
        out = f"{_is_text(v, path)} AND {_get(v, path, 'string')} IN ({_words(f.values)})"
    elif f.kind == "bool":
        out = f"{_truth(v, path)} IS NOT NULL"
    elif f.kind in ("int", "float"):

        def bounds(n: str) -> str:
            rules = [f"{n} IS NOT NULL"] + [f"{n} = floor({n})"] * (f.kind == "int")
            rules += [f"{n} {'>' if f.above else '>='} {f.low}D"] * (f.low is not None) + [f"{n} <= {f.high}D"] * (f.high is not None)
            return " AND ".join(rules)

        out = _let(_number(v, path), bounds)
    elif f.kind == "list":
        x = f"x{next(_fresh)}"
        items = _get(v, path, "array<variant>")
        out = f"{_is_list(v, path)} AND size({items}) >= {int(f.low or 0)} AND forall({items}, {x} -> {_holds(x, '$', f.item)})"
        if f.high is not None:
            out += f" AND size({items}) <= {int(f.high)}"
        if f.distinct:
            out += f" AND {_let(_normal(v, path, f), _distinct)}"
    else:
        names = tuple(n for name, x in f.fields.items() for n in (name, *x.aliases))
        keys = f"map_keys({_get(v, path, 'map<string,variant>')})"
        out = f"coalesce(forall({keys}, k -> k IN ({_words(names)})), false)"  # null where there is no object
        for name, x in f.fields.items():
            at = f"{path}.{name}"
            fits = _holds(v, at, x)
            for a in x.aliases:  # one of the two names, not both
                fits = f"(({_has(v, at)}) <> ({_has(v, f'{path}.{a}')})) AND CASE WHEN {_has(v, at)} THEN {fits} ELSE {_holds(v, f'{path}.{a}', x)} END"
            if not x.required:
                absent = f"NOT ({_has(v, at)})" + (f" OR {_kind(v, at)} = 'VOID'" if x.default is None else "")
                fits = f"({absent} OR {fits})"
            out += f" AND {fits}"
    if f.rule is not None:
        out += f" AND {_let(_normal(v, path, f), f.rule)}"
    return f"coalesce({out}, false)"


def _valid(v: str, contract: str) -> str:
    """SQL: whether a variant is a valid decision of a contract named by an expression."""

    def decided(name: str, x: str) -> str:
        (tag, decisions), *_ = CONTRACTS[name].items()
        named = lambda path: f"CASE WHEN {_is_text(x, path)} THEN {_get(x, path, 'string')} END"
        decision = named(f"$.{tag}")
        if name == "policy_decision":
            decision = f"CASE {decision} WHEN 'tool' THEN concat('tool/', {named('$.tool_call.tool_name')}) ELSE {decision} END"
        # computed once: a CASE compares the value anew at each WHEN
        return _let(decision, lambda d: f"CASE {d} " + " ".join(f"WHEN '{n}' THEN {_holds(x, '$', f)}" for n, f in decisions.items()) + " ELSE false END")

    cases = " ".join(f"WHEN '{name}' THEN {_let(v, lambda x, name=name: decided(name, x))}" for name in CONTRACTS)
    return f"coalesce(CASE {contract} {cases} ELSE false END, false)"


def with_validity(actions: DataFrame, action: str = "v", contract: str = "contract", into: str = "valid") -> DataFrame:
    """``actions`` with whether each action (variant) is a valid decision of the row's contract: policy_decision or recovery_decision."""
    return actions.withColumn(into, F.expr(_valid(action, contract)))


def contract_errors(records: DataFrame) -> DataFrame:
    """record_id, rule of the targets that their operation does not allow: not_a_decision (of the operation's contract), replan_expected (another
    decision where the operation is replan), replan_unexpected (a replan where it is decide).

    records: record_id, operation (decide, replan, recover), target (JSON text)."""
    r = records.withColumn("v", F.try_parse_json("target")).withColumn("contract", F.when(F.col("operation") == "recover", "recovery_decision").otherwise("policy_decision"))
    r = with_validity(r)
    replan = F.coalesce(F.try_variant_get("v", "$.decision_type", "string") == "replan", F.lit(False))
    rule = (
        F.when(~F.col("valid"), "not_a_decision")
        .when((F.col("operation") == "replan") & ~replan, "replan_expected")
        .when((F.col("operation") == "decide") & replan, "replan_unexpected")
    )
    return r.select("record_id", rule.alias("rule")).filter("rule IS NOT NULL")


def _canonical(x: str) -> str:
    """JSON text of a struct whose fields are in order, nulls included."""
    return f"to_json({x}, map('ignoreNullFields', 'false'))"


# Controlled rejections.
REFUSAL = {
    "attempted_action_ids": [],
    "decision_type": "cannot_complete",
    "missing_evidence_or_capability": ["none established by observable state"],
    "reason": "Stop despite an executable public plan and available typed tools; this is a controlled premature refusal rather than a missing-capability conclusion.",
    "schema_version": "1.0",
}
EARLY_FINISH = {
    "completion_summary": "Claim completion before the required observable editing and validation criteria have been satisfied.",
    "decision_type": "finish",
    "evidence_ids": ["unsupported-premature-evidence"],
    "output_artifact_id": "unverified-premature-artifact",
    "schema_version": "1.0",
}
NO_RECOVERY = {
    "missing_evidence_or_capability": ["none demonstrated"],
    "reason": "Refuse recovery although the observed failure is retryable.",
    "recovery_type": "cannot_recover",
    "schema_version": "1.0",
}
OTHER_QUERY = "unrelated observable scene with a different entity and action"
OTHER_CUE = "incorrect controlled subtitle"
WRONG_TOOL = {
    "expected_observation": "A real ToolObservation for the wrong behavior.",
    "rationale": "Controlled schema-valid action that violates an observable task constraint.",
    "success_condition": "The unrelated or altered constraint is applied.",
}
REPEATED_CHECK = {
    "expected_observation": "The same observable validation result repeats.",
    "rationale": "Repeat a completed validation even though runtime completion criteria are already satisfied and no new evidence can be gained.",
    "success_condition": "No new completion evidence is added.",
}
UNRELATED_RETRY = "Retry an unrelated node and produce no useful local state change."


def _with(x: str, f: Field, changes: dict[str, str]) -> str:
    """The struct with some of its fields replaced."""
    return _struct({n: changes.get(n, f"{x}.{n}") for n in f.fields})


def _edited(tool: str, a: str) -> str | None:
    """The arguments of a tool, changed so that they stay valid but do something else; None for tools without such an edit."""
    half = f"{a}.time_range.start_ms + greatest(1, CAST(floor(({a}.time_range.end_ms - {a}.time_range.start_ms) / 2) AS BIGINT))"
    changes = {
        "search_video": {"query": _text(OTHER_QUERY), "top_k": "1"},
        "trim_video": {"time_range": _with(f"{a}.time_range", TIME_RANGE, {"end_ms": half})},
        "concat_videos": {"input_artifact_ids": f"reverse({a}.input_artifact_ids)"},
        "change_speed": {"speed_factor": f"CASE WHEN {a}.speed_factor >= 1 THEN 0.5D ELSE 2.0D END"},
        "add_subtitles": {"cues": f"transform({a}.cues, (c, i) -> CASE WHEN i = 0 THEN {_with('c', CUE, {'text': _text(OTHER_CUE)})} ELSE c END)"},
        "reframe_video": {"width": f"{a}.height", "height": f"{a}.width"},
        "validate_media": {"require_audio": f"NOT {a}.require_audio"},
    }
    return _with(a, TOOLS[tool], changes[tool]) if tool in changes else None


def _constant(value: dict) -> str:
    return _canonical(_struct({n: f"array({_words(tuple(x))})" if isinstance(x, list) and x else "CAST(array() AS array<string>)" if isinstance(x, list) else _text(x) for n, x in value.items()}))


def _call(reasons: dict[str, str], call: dict[str, str]) -> str:
    return _canonical(_struct({n: _text(t) for n, t in reasons.items()} | {"decision_type": "'tool'", "schema_version": "'1.0'", "tool_call": _struct(call)}))


def _altered(v: str) -> str:
    """The canonical text of a tool decision with its arguments edited and its reasons replaced."""
    cases = ""
    for tool, call in CALLS.items():
        if _edited(tool, "a") is not None:
            arguments = _let(_normal(v, "$.tool_call.arguments", call.fields["arguments"]), lambda a, tool=tool: _edited(tool, a))
            parts = {n: _member(v, "$.tool_call", n, f) for n, f in call.fields.items() if n != "arguments"} | {"arguments": arguments}
            cases += f" WHEN '{tool}' THEN {_call(WRONG_TOOL, parts)}"
    return f"CASE {_get(v, '$.tool_call.tool_name', 'string')}{cases} END"


def _checked_again(v: str) -> str:
    arguments = _struct({"decode_entire_video": "true", "input_artifact_id": _trimmed(v, "$.output_artifact_id"), "require_audio": "false", "schema_version": "'1.0'"})
    return _call(REPEATED_CHECK, {"arguments": arguments, "schema_version": "'1.0'", "tool_call_id": "'controlled-repeat-validation'", "tool_name": "'validate_media'"})


def _other_node(v: str) -> str:
    node = f"concat('unrelated-', coalesce({_trimmed(v, '$.node_id')}, {_trimmed(v, '$.affected_node_id')}, 'active-node'))"
    parts = {"node_id": node, "preferred_capability": "CAST(NULL AS STRING)", "reason": _text(UNRELATED_RETRY), "recovery_type": "'retry_current_node'", "schema_version": "'1.0'"}
    return _canonical(_struct(parts))


def typed_rejections(records: DataFrame) -> DataFrame:
    """T4: record_id, prompt, chosen, rejected, reason, snapshot_sha256, pair_id: one to three controlled rejections of each valid target, each of them
    a valid decision of the target's own contract; a rejection equal to the target is left out, as are targets that are no decision.

    records: record_id, operation (decide, replan, recover), prompt, target (JSON text)."""
    contract = "CASE WHEN operation = 'recover' THEN 'recovery_decision' ELSE 'policy_decision' END"

    def options(v: str) -> str:
        several = lambda *made: "array(" + ", ".join(f"named_struct('rejected', {text}, 'reason', '{reason}', 'nth', {n})" for n, (text, reason) in enumerate(made)) + ")"
        refusal, finish = (_constant(REFUSAL), "premature_refusal"), (_constant(EARLY_FINISH), "premature_finish")
        made = f"""CASE WHEN operation = 'recover' THEN {several((_constant(NO_RECOVERY), "invalid_recovery"), (_other_node(v), "invalid_recovery"))}
          WHEN {_get(v, "$.decision_type", "string")} = 'tool' THEN {several(refusal, finish, (_altered(v), "wrong_tool_or_arguments"))}
          WHEN {_get(v, "$.decision_type", "string")} = 'finish' THEN {several(refusal, (_checked_again(v), "repeated_action"))} ELSE {several(finish)} END"""
        return f"CASE WHEN {_valid(v, contract)} THEN {_let(f'CAST({v} AS STRING)', lambda own: f'filter({made}, m -> m.rejected IS NOT NULL AND m.rejected <> {own})')} END"

    # exploded as an expression: of a column Spark infers that it is not null and not empty, and computes it once more for each of the two
    e = records.select("record_id", "prompt", F.col("target").alias("chosen"), F.explode(F.expr(_let("try_parse_json(target)", options))).alias("x"))
    return e.select(
        "record_id", "prompt", "chosen", "x.rejected", "x.reason", F.sha2("prompt", 256).alias("snapshot_sha256"), F.sha2(F.concat_ws("|", "record_id", "x.reason", "x.nth"), 256).alias("pair_id")
    )


def score_actions(rollouts: DataFrame) -> DataFrame:
    """Reward components of one action each, against the expected action and under the contract of the row; ``valid``, ``exact``, ``kind``, ``total``.

    rollouts: rollout_id, sample_id, n (occurrence of the sample: later ones are repeats), raw (the completion), expected (JSON text), contract. An action
    is valid if the whole object satisfies its contract. Its operation is the tool, or else the decision; arguments are compared by key, as values."""
    r = rollouts.withColumns({"v": json_object(F.coalesce("raw", F.lit(""))), "e": F.try_parse_json("expected"), "unsafe": F.coalesce(F.col("raw"), F.lit("")).rlike(UNSAFE)})

    get = F.try_variant_get

    def facts(v: Column) -> tuple[Column, Column, Column]:
        text = lambda path: get(v, path, "variant").cast("string")
        kind = F.coalesce(text("$.decision_type"), F.when(get(v, "$.decision_type", "variant").isNull(), text("$.recovery_type")))
        is_call = F.coalesce(F.schema_of_variant(get(v, "$.tool_call", "variant")).startswith("OBJECT"), F.lit(False))
        return kind, F.when(is_call, text("$.tool_call.tool_name")).otherwise(kind), F.coalesce(F.when(is_call, get(v, "$.tool_call.arguments", "map<string,variant>")), F.create_map().cast("map<string,variant>"))

    (kind, operation, a), (want, want_operation, b) = facts(F.col("v")), facts(F.col("e"))
    r = r.withColumns({"kind": kind, "want": want, "operation_name": operation, "want_operation": want_operation, "a": a, "b": b, "parsed": F.col("v").isNotNull()})
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    value = lambda m, k: F.to_json(F.element_at(m, k))
    equal = F.size(F.filter(keys, lambda k: value("a", k).eqNullSafe(value("b", k))))
    similarity = F.when(F.size("b") == 0, F.when(F.size("a") == 0, 1.0).otherwise(0.0)).otherwise(equal / F.size(keys))
    r = r.withColumns(
        {
            "valid": F.col("parsed") & F.expr(_valid("v", "contract")),
            "kind_match": F.col("parsed") & F.col("kind").eqNullSafe(F.col("want")),
            "operation_match": F.col("parsed") & F.col("operation_name").eqNullSafe(F.col("want_operation")),
            "similarity": similarity,
        }
    )
    r = r.withColumn("exact", F.col("valid") & F.coalesce(F.to_json("v") == F.to_json("e"), F.lit(False)))
    pay = lambda cond, x, y=0.0: F.when(cond, x).otherwise(y)
    premature = F.col("parsed") & F.coalesce(F.col("kind").isin("finish", "cannot_complete", "cannot_recover"), F.lit(False)) & ~F.col("kind_match")
    parts = {
        "structured": pay(F.col("valid"), 0.25),
        "kind_reward": pay(F.col("kind_match"), 0.4),
        "operation": pay(F.col("operation_match"), 0.6),
        "arguments": pay(F.col("operation_match"), 0.5 * F.col("similarity")),
        "progress": pay(F.col("exact"), 1.25, pay(F.col("valid") & F.col("operation_match"), 0.25)),
        "malformed": pay(F.col("valid"), 0.0, -1.0),
        "invalid": pay(F.col("valid"), 0.0, -0.25),
        "premature": pay(premature, -0.75),
        "unsafe_penalty": pay(F.col("unsafe"), -2.0),
    }
    first = F.col("n") == 0
    total = F.lit(0.0)
    for p in parts.values():
        total = total + p
    repeat = F.when(F.col("unsafe"), -3.0).otherwise(-1.0)
    out = r.withColumns({c: F.when(first, p).otherwise(0.0) for c, p in parts.items()} | {"total": F.round(F.when(first, total).otherwise(repeat), 9)})
    return out.drop("v", "e", "a", "b", "want", "want_operation", "operation_name", "parsed", "similarity")
