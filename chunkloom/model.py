"""Schemas of documents, blocks and chunks, element types and error codes."""

from __future__ import annotations

from dataclasses import dataclass, field

BBOX = "struct<x:float,y:float,width:float,height:float>"
TABLE = "struct<rows:array<array<string>>,headers:array<string>>"
BLOCK = f"struct<element_type:string,text:string,bbox:{BBOX},page:int,confidence:float,hierarchy:array<string>,metadata:map<string,string>,table_data:{TABLE}>"
CHUNK_COLUMNS = f"chunk_idx int, id string, text string, token_count bigint, source_blocks array<{BLOCK}>, page_start int, page_end int, overlap_prefix string, confidence float"

#: snake_case name: (name in columnar output, name in the element-compatibility schema)
ELEMENTS = {
    "title": ("Title", "Title"), "header": ("Header", "Header"), "narrative_text": ("NarrativeText", "NarrativeText"), "list_item": ("ListItem", "ListItem"),
    "table": ("Table", "Table"), "image": ("Image", "Image"), "page_break": ("PageBreak", "UncategorizedText"), "footer": ("Footer", "Footer"),
    "caption": ("Caption", "NarrativeText"), "formula": ("Formula", "UncategorizedText"), "code_block": ("CodeBlock", "UncategorizedText"),
    "address": ("Address", "NarrativeText"), "email_body": ("EmailBody", "NarrativeText"), "email_header": ("EmailHeader", "Header"), "unknown": ("Unknown", "UncategorizedText"),
}

E_IO, E_MODEL, E_INPUT, E_PARSE, E_WRITE, E_CONFIG = "E1001", "E1002", "E2001", "E3001", "E4001", "E5001"


class DocError(Exception):
    """A failure of one document; it becomes a row's error column and never ends a job."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


@dataclass
class Block:
    element_type: str
    text: str
    page: int = 1
    confidence: float = 1.0
    hierarchy: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    rows: list[list[str]] | None = None
    headers: list[str] | None = None
    bbox: tuple[float, float, float, float] | None = None

    def row(self) -> dict:
        """In the shape of the BLOCK schema."""
        table = None if self.rows is None else {"rows": self.rows, "headers": self.headers}
        box = None if self.bbox is None else dict(zip(("x", "y", "width", "height"), self.bbox, strict=True))
        return {"element_type": self.element_type, "text": self.text, "bbox": box, "page": self.page, "confidence": self.confidence, "hierarchy": self.hierarchy, "metadata": list(self.metadata.items()), "table_data": table}
