"""Gridloom: gridded-imagery analytics as Spark DataFrame jobs."""
