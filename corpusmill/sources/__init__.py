"""Readers and writers: declared schemas, file formats, binary plug-ins."""
