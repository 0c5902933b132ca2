"""Fixed schemas of the evidence tables, as DDL. Reads never infer; `run_id` is the partition column of stored tables."""


NODES = "id string, kind string, label string, path string, attributes map<string,string>, ordinal long"
EDGES = "id string, source string, target string, kind string, ordinal long"
REFS = "owner_id string, evidence_node_id string, file string, start_line int, end_line int, excerpt string, ordinal long"
CONFLICTS = "id string, severity string, summary string, evidence_node_ids array<string>"
CITATIONS = "owner_id string, ordinal long, evidence_node_id string, file string, start_line int, end_line int, rationale string"
ITEMS = "id string, kind string, parent_id string, name string, summary string, path string, extra map<string,string>, confidence_level string, confidence_rationale string, ordinal long"
_PROVENANCE = "array<struct<source:string, subject_id:string, file:string, symbol:string, start_line:int, end_line:int>>"
_ANNOTATIONS = "array<struct<name:string, qualified_name:string, values:map<string,string>>>"
TYPES = f"source string, id string, package_name string, simple_name string, qualified_name string, kind string, super_class string, interfaces array<string>, annotations {_ANNOTATIONS}, provenance {_PROVENANCE}, ordinal long"
FIELDS = f"source string, type_id string, id string, name string, type string, erased_type string, nullable boolean, primary_key boolean, annotations {_ANNOTATIONS}, provenance {_PROVENANCE}, ordinal long"
METHODS = (
    "source string, type_id string, id string, name string, return_type string, erased_return_type string, visibility string, constructor boolean, synthetic boolean, bridge boolean, "
    f"annotations {_ANNOTATIONS}, thrown_types array<string>, body struct<normalized_source:string, call_edges:array<struct<owner_type:string, method_name:string>>, literals:array<string>>, provenance {_PROVENANCE}, ordinal long"
)
PARAMS = f"source string, method_id string, id string, name string, type string, erased_type string, nullable boolean, annotations {_ANNOTATIONS}, provenance {_PROVENANCE}, ordinal long"
ENDPOINTS = f"source string, id string, method_id string, bean_name string, http_method string, full_path string, provenance {_PROVENANCE}, ordinal long"
BEANS = "source string, id string, name string, type_id string, scope string, ordinal long"
ENTITIES = "source string, id string, type_id string, table_name string, ordinal long"
VALIDATIONS = "source string, id string, target_id string, annotation string, ordinal long"
SECURITIES = "source string, id string, target_id string, kind string, expression string, ordinal long"
RUNS = "id string, project_id string, parent_run_id string, kind string, status string, started_at timestamp, finished_at timestamp, artifact_path string, metadata_json string, log_text string"
STAGES = "array<struct<kind:string, status:string, runId:string, artifactPath:string, startedAt:string, finishedAt:string, detail:string>>"
_MEMBERS = "array<struct<name:string, type:string, pk:boolean, nullable:boolean>>"
SPEC = (
    "schema_version int, service struct<name:string, base_package:string>, generation boolean, external boolean, performance struct<page:int, batch:int, cache:boolean>, "
    "messaging struct<delivery:string, key:string, attempts:int, backoff:string, dlq:string>, tags array<string>, bounded_contexts array<struct<name:string, aggregates:array<struct<name:string, identity:struct<type:string, field:string>, "
    f"entities:array<struct<name:string, table:string, fields:{_MEMBERS}>>, events:array<struct<name:string, topic:string, format:string, payload:{_MEMBERS}>>, "
    f"commands:array<struct<name:string, method:string, path:string, input:{_MEMBERS}, rules:array<struct<id:string, type:string, ensure:string>>, emits:array<string>>>, "
    "machine:struct<name:string, initial:string, states:array<string>, transitions:array<struct<on:string, from:array<string>, to:string>>>, hooks:array<struct<name:string, signature:string, optional:boolean>>>>>>"
)
