"""Markdown manuals to rows: blocks, sections, tables, diagrams, references and chunks."""
