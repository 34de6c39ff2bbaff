"""Schemas of the graph and evidence tables."""

GRAPH = {
    "equipment": "graph_id string, ord int, id string, equipment_id string, type string, page int, bbox struct<x1:double,y1:double,x2:double,y2:double>, attributes map<string,string>, confidence double, provenance array<string>, review_status string",
    "terminals": "graph_id string, ord int, id string, equipment_id string, name string, x double, y double",
    "connections": "graph_id string, ord int, id string, from_terminal_id string, to_terminal_id string, polyline array<struct<x:double,y:double>>, switch_state string, confidence double, provenance array<string>, review_status string",
    "overrides": "graph_id string, variant_id string, equipment_id string, state string",
}
_RUN = "analysis_run_id string"
_BOX = "bbox struct<x1:double,y1:double,x2:double,y2:double>"
_LINE = "polyline array<struct<x:double,y:double>>"
EVIDENCE = {
    "projects": "id string, name string, description string, created_at timestamp_ntz",
    "drawings": "id string, project_id string, original_filename string, media_type string, sha256 string, size_bytes long, width int, height int, page_count int, input_type string, uploaded_at timestamp_ntz",
    "analysis_runs": "id string, drawing_id string, status string, pipeline_version string, error string, created_at timestamp_ntz, completed_at timestamp_ntz",
    "analysis_stages": f"{_RUN}, id string, name string, status string, message string, started_at timestamp_ntz, completed_at timestamp_ntz",
    "artifacts": f"{_RUN}, id string, artifact_type string, page int, path string, sha256 string, metadata string",
    "text_evidence": f"{_RUN}, id string, page int, raw_text string, normalized_text string, text_type string, ocr_confidence double, normalization_confidence double, semantic_confidence double, {_BOX}, engineer_value string, engineer_text_type string, review_status string",
    "symbol_evidence": f"{_RUN}, id string, page int, predicted_class string, original_predicted_class string, confidence double, {_BOX}, review_status string, review_reason string",
    "associations": f"{_RUN}, id string, text_evidence_id string, symbol_evidence_id string, score double, factors map<string,double>, status string",
    "conductors": f"{_RUN}, id string, page int, {_LINE}, confidence double, provenance string, masked_interruption boolean",
    "busbars": f"{_RUN}, id string, page int, {_LINE}, {_BOX}, confidence double, provenance string, symbol_id string",
    "junctions": f"{_RUN}, id string, page int, x double, y double, kind string, degree int, confidence double, provenance string, review_status string",
    "terminals": f"{_RUN}, id string, symbol_id string, symbol_class string, page int, name string, x double, y double, orientation_deg int, orientation_confidence double",
    "candidates": f"{_RUN}, id string, page int, from_node_id string, to_node_id string, conductor_id string, {_LINE}, visual double, endpoint double, orientation double, terminal double, junction double, structural double, overall_confidence double, provenance string, review_status string, review_reason string, gap_bridge boolean",
    "physical_connections": f"{_RUN}, id string, drawing_id string, candidate_id string, page int, from_node_id string, to_node_id string, {_LINE}, confidence double, provenance string, review_status string",
    "topology_issues": f"{_RUN}, id string, kind string, message string, severity string, related_edge_id string",
    "review_actions": f"{_RUN}, id string, target_table string, target_id string, action string, payload map<string,string>, actor string, created_at timestamp_ntz",
    "switch_states": f"{_RUN}, equipment_id string, state string, provenance string",
    "scenario_runs": f"{_RUN}, id string, name string, overrides map<string,string>, result string",
    "export_artifacts": f"{_RUN}, id string, export_type string, sha256 string, created_at timestamp_ntz",
}
#: Closed word lists of string columns.
DOMAINS = {
    "provenance": ("synthetic_ground_truth", "native_cad", "vector_pdf", "vision", "ocr", "geometry", "wire_trace", "terminal_snap", "graph_inference", "electrical_rule", "engineer_verified"),
    "review_status": ("pending", "accepted", "verified", "rejected"),
    "equipment_type": ("energy_source", "grid_incomer", "generator", "power_transformer", "busbar", "circuit_breaker", "disconnector", "current_transformer", "potential_transformer", "feeder", "load", "bus_coupler", "offpage_connector", "junction", "generic_equipment"),
    "switch_state": ("open", "closed", "unknown"),
    "crossing_kind": ("connected_junction", "crossover_no_connection", "ambiguous_crossing"),
    "text_type": ("equipment_id", "feeder_id", "bus_id", "voltage", "current_rating", "power_rating", "switch_state", "destination_label", "source_label", "description", "unknown"),
    "resolution": ("resolved", "ambiguous", "unresolved"),
    "input_type": ("raster_image", "vector_pdf", "raster_pdf", "hybrid_pdf", "unknown"),
}
