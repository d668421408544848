"""DataFrame operators over catalogs, versions, lines, sections and layouts."""
