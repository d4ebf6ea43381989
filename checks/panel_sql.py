"""The panel as one SQL text for the cross-check engine (see FIXTURES.md F5)."""

PANEL_SQL = open(__file__.replace("panel_sql.py", "panel.sql")).read()


def with_panel(body: str) -> str:
    """Prefix a query over ``clientes``; a body that starts with ``,`` adds further CTEs."""
    return f"WITH clientes AS (\n{PANEL_SQL}\n){body if body.lstrip().startswith(',') else ' ' + body}"
