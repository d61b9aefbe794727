"""Spark schemas of the tables that enter or leave the engine."""

from __future__ import annotations

EMAIL = (
    "email_id string, `from` string, subject string, body string, "
    "attachments array<string>, received_at string"
)
SUBMISSION = (
    "struct<category:string,status:string,review_reason:string,has_defect:boolean,"
    "defect_fields:array<string>,decided_by:string>"
)
# Where a text sits. ``kind`` is text_range, pdf_page, docx_paragraph,
# docx_table_cell or sheet_cell; ``place`` names the page, paragraph, table cell
# (table:row:column) or sheet cell (sheet!cell); a text range has start and end.
LOCATOR = "struct<kind:string,place:string,start:int,end:int>"
# One label/value unit of a document.
BLOCK = (
    f"struct<ord:int,label:string,value:string,locator:{LOCATOR},label_locator:{LOCATOR},"
    f"extra:array<struct<locator:{LOCATOR},text:string>>>"
)
CELL = (
    "document_id string, kind string, container string, row int, col int, "
    "cell_type string, text_value string, num_value double, formula string"
)
PAGE = "document_id string, page int, text string, has_images boolean"
EVENT = "event_id string, case_id string, run_id string, at timestamp, type string, actor string"
KEY = ["run_kind", "case_id"]
