"""Defaults and fixed vocabularies."""

from __future__ import annotations

# Limits, sizes and thresholds of the operators.
CHUNK_WORDS, CHUNK_OVERLAP, MAX_CHUNKS = 1400, 100, 8
MAX_ENTITIES, MAX_RELATIONS, MAX_FACTS = 10, 10, 5
MERGE_COSINE, MERGE_RATIO = 0.86, 0.5
QUERY_K, LINK_K, MINDMAP_NODES = 8, 20, 250
DIGEST_ENTITIES, DIGEST_PER_TYPE, DIGEST_RELATIONS, DIGEST_FACTS = 30, 6, 14, 12
NODE_ALIASES, NODE_SOURCES, NODE_FACTS, FACT_NODES = 8, 8, 12, 4
DEDUP_EXACT_CHARS, DEDUP_VARIANT_CHARS, VARIANT_LOW, VARIANT_HIGH = 200, 300, 0.6, 1.7
OCR_MODE, OCR_LANG, OCR_PAGES, OCR_LEAST_CHARS, VISION_MODE = "auto", "eng", 60, 200, "auto"
#: A third of failed chunks or more, from this many chunks on, means that the provider is down.
FAILED_SHARE, FAILED_LEAST = 0.34, 6

# Entity types and their colours.
TYPE_COLORS = {
    "Person": "#e6550d",
    "Organization": "#3182bd",
    "Project": "#9e4dd6",
    "Document": "#7b7b7b",
    "Policy": "#31a354",
    "Product": "#e7ba52",
    "Location": "#17becf",
    "Milestone": "#d6616b",
    "Metric": "#2ca02c",
    "Process": "#1f77b4",
    "Issue": "#d62728",
    "Concept": "#8c6d31",
    "Event": "#bd9e39",
    "System": "#637939",
    "_default": "#999999",
}
ENTITY_TYPES = [t for t in TYPE_COLORS if t != "_default"]
# Pointer stubs without content, and names that are no documents.
SKIP_EXTS = [".gdoc", ".gslides", ".gsheet", ".gdrive", ".gform", ".gjam", ".gsite", ".gmap", ".gtable", ".glink", ".lnk", ".url", ".webloc"]
SKIP_NAMES = [".DS_Store", ".localized", "Icon\r"]
IMAGE_EXTS = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic"]
AUDIO_EXTS = [".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg"]
# Names that leak from provenance marks and recognised text, with this package's own marks.
MARK = "recollect"
JUNK_NAMES = [f"{MARK} source", f"{MARK} method", "page", "source", "method", "chunk", "image", "ocr text"]
# Beginnings of picture captions taken for names.
CAPTIONS = ["the image", "this image", "image shows", "the photo", "a photo", "the picture", "an image", "the diagram shows"]
