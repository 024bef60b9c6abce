"""Schemas of the canonical tables, as DDL text for ``read.schema`` and ``createDataFrame``."""

SPANS = (
    "doc_id bigint, page_number int, raw_index int, line_index int, span_index int, text string, size double, "
    "bbox array<double>, raw_type string, image_path string"
)
BLOCKS = (
    "doc_id bigint, block_id string, page_number int, order_index int, block_type string, text string, "
    "y0 double, max_size double, bbox array<double>, image_path string"
)
SNAPSHOTS = "doc_id bigint, page_number int, page_snapshot_path string"
FIGURES = (
    "doc_id bigint, caption_order int, figure_id string, caption string, page_number int, "
    "caption_block_ids array<string>, reference_block_ids array<string>, referenced_text_spans array<string>, "
    "image_block_paths array<string>, page_snapshot_path string"
)
SECTIONS = "doc_id bigint, section_key string, content string, position int, source string"
STRUCTURE = (
    "doc_id bigint, title string, authors array<string>, doi string, venue string, year string, abstract string, "
    "page_count int, figure_count int, section_order array<string>, discarded_noise array<string>, "
    "uncertainties array<string>"
)
PANEL = (
    "struct<panel_id:string,panel_label:string,panel_type:string,summary:string,visible_text:array<string>,"
    "axes:array<string>,legend_items:array<string>,confidence:string>"
)
ARTIFACTS = (
    "doc_id bigint, caption_order int, figure_id string, page_number int, figure_type string, "
    "extraction_source string, page_snapshot_path string, image_block_paths array<string>, crop_path string, "
    f"visible_text array<string>, axes array<string>, legend_items array<string>, panels array<{PANEL}>, "
    "direct_evidence array<string>, uncertainties array<string>, confidence string"
)
EVIDENCE = (
    "doc_id bigint, caption_order int, figure_id string, figure_title_or_caption string, page_number int, "
    "figure_type string, compared_items array<string>, metrics_or_axes array<string>, direct_evidence array<string>, "
    "referenced_text_spans array<string>, semantic_source string, evidence_quality string, uncertainties array<string>"
)
ANALYSES = (
    "doc_id bigint, caption_order int, figure_id string, figure_title_or_caption string, experiment_focus string, "
    "compared_items array<string>, metrics_or_axes array<string>, main_observations array<string>, "
    "claimed_conclusion string, consistency_check string, confidence string"
)
RESPONSES = "response_id bigint, doc_id bigint, kind string, raw string"
RESULTS = (
    "doc_id bigint, title string, summary string, key_points array<string>, limitations array<string>, "
    "markdown_report string, structured_data string"
)
JOB_EVENTS = "job_id bigint, event_id bigint, ts timestamp, status string, error_message string"
JOB_LOGS = "job_id bigint, event_id bigint, ts timestamp, line string"
