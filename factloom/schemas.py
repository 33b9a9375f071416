"""Schemas of the stored tables. Nested values are structs, so that Parquet reads only the members that are used."""

from __future__ import annotations

from factloom.functions.numbers import SCHEMA as NUMBER

PERIOD = "struct<label:string,start:date,end:date>"
VALUE = "struct<kind:string,raw:string,number:decimal(37,10),reported:decimal(24,8),dp:int,scale:decimal(12,2),unit:string,reported_unit:string,currency:string,approximate:boolean,text:string,date_value:date,precision:string,bool_value:boolean,identifier:string,scheme:string>"
CONTEXT = f"struct<period:{PERIOD},scope:string,basis:string,as_of:date,geography:string,publisher:string,qualifiers:map<string,string>>"
BLOCKS = "document_id string, page_index int, page_width double, page_height double, block_no int, x0 double, y0 double, x1 double, y1 double, text string"
CELLS = "document_id string, page_index int, table_index int, row_index int, column_index int, text string"
PASSAGES = "id string, document_id string, page_index int, reading_order int, role string, text string, char_start int, char_end int, text_hash string"
FACTS = f"id string, subject_id string, predicate_key string, value {VALUE}, context {CONTEXT}, document_id string, passage_id string, quote string, quote_start int, quote_end int, extraction_confidence double, normalization_confidence double, review_state string, warnings array<string>"
RESPONSES = "passage_hash string, model string, schema_version int, prompt_version int, response_json string, validation_result string"

STATUSES = ("registered", "processing", "complete", "partial", "failed")
REVIEW_STATES = ("ready", "needs_review", "rejected")
RELATIONS = ("corroborates", "contradicts", "likely_contradiction", "reconciled_by_period", "reconciled_by_scope", "reconciled_by_basis", "reconciled_by_as_of", "reconciled_by_unit", "incomparable", "needs_review")
VALUE_KINDS = ("number", "text", "category", "date", "boolean", "identifier")
__all__ = ["BLOCKS", "CELLS", "CONTEXT", "FACTS", "NUMBER", "PASSAGES", "PERIOD", "RELATIONS", "RESPONSES", "REVIEW_STATES", "STATUSES", "VALUE", "VALUE_KINDS"]
