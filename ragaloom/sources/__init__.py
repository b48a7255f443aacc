"""Readers and writers: pitch files, recordings, lyric pages, catalogs and meanings."""
