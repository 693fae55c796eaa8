"""Schemas of the document tables."""

from __future__ import annotations

ITEMS = "array<struct<text:string,text_rich:string,style:string>>"
#: A block of a document. node orders the headings' nodes as a reader meets them, block_pos the blocks of a node.
BLOCKS = f"doc_id string, doc_title string, h1 string, h2 string, node int, block_pos int, type string, text string, text_rich string, signature string, items {ITEMS}, rows array<array<string>>, rows_rich array<array<string>>, style map<string,array<string>>, error string"
BLOCK_NAMES = ("doc_id", "doc_title", "h1", "h2", "node", "block_pos", "type", "text", "text_rich", "signature", "items", "rows", "rows_rich", "style", "error")
COMMENTS = "doc_id string, id string, author string, date string, text string, anchor_heading_path array<string>, anchor_text string, anchor_text_rich string, anchor_context string, anchor_context_rich string"
LAYOUT = "source_file string, page int, text string, bbox array<double>, font_size double, is_bold boolean, body_font double"
RECORD = (
    "doc_id string, source_file string, page int, block_type string, text string, raw_text string, section_title string, section_path array<string>, "
    "table_id string, table_title string, row_id int, parent_id string, priority double, metadata struct<fallback:boolean,table_name:string,schema:string,entry_number:int,csv_path:string>"
)
