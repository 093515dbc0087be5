"""Writers: tables for metrics and errors, VTU surfaces, chunked arrays, Markdown reports."""
