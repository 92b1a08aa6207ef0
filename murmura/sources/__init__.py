"""Reading and writing tables, exports, annotation documents, audio."""
