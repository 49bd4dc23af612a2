"""Six small design documents of our own, in which every kind of edge occurs."""

BASE = """Doc: 1
Title: A Cache for everyone
Author: Ann Lee <ann@example.org>,
  "Bob Ray" <bob@x.example.org>
Status: Final
Type: Standards Track
Version: 1.0, 1.1
Created: 02-Jan-2001
Discussions-To: list at mail.example.org

Abstract
========

This document adds a ``Cache`` that keeps results of costly calls, so that caching needs no code of its own.

Motivation
==========

Everyone writes a Cache by hand today, and every Cache is wrong in its own way. Caching is hard to get right.

Rejected Ideas
==============

Caching on disk
---------------

A Cache on disk was rejected because it is slow and nobody asked for it. It would also need locks between processes.

No cache at all
---------------

However, doing nothing was rejected because:

Users would be confused by stale copies and hand-written caching code all over the place.
"""
EXTENSION = """Doc: 2
Title: Cache sizes
Author: Ann Lee <ANN@other.example.org>
Sponsor: Cy Day <cy@example.org>
Status: Accepted
Type: Standards Track
Created: 2003-05-06
Requires: 1
Delegate: Cy Day <cy@example.org>
Discussions-To: https://forum.example.org/t/2

Abstract
========

Bound the size of a ``Cache``. The Cache of :doc:`1` grows without limit. A Cache on disk that is fast keeps old results.

Specification
=============

The Cache takes a limit, as in doc 0001. The compiler ignores it, and so does a linter.

Backwards Compatibility
=======================

Old calls of the Cache go on working. Nothing breaks in practice, though a pickled Cache is incompatible with older ones.

Reference Implementation
========================

There is a branch of the compiler with this.
"""
REJECTED = """Doc: 3
Title: A pipe operator
Author: Dee Fox
Status: Rejected
Type: Standards Track
Created: 01-Feb-2004

Abstract
========

Add ``Pipe`` and a pipe operator that passes a result on, next to the stream of doc 4.

Rejection Notice
================

The operator was rejected because its syntax is confusing. It would break existing code as well.
"""
DRAFT = """Doc: 4
Title: Streams of records
Author: Dee Fox, Eli Gray
Status: Draft
Type: Standards Track
Created: 01-Mar-2005
Replaces: 9

Abstract
========

A Stream of Record values, with record types for each. Stream handling builds on the Cache of doc 1 and on doc 77.

Open Issues
===========

It is unclear who closes the Stream, and hard to read code that does so.

Alternatives
============

Using the Pipe of doc 3 was considered, but doc 3 was not worth it.
"""
OLD = """Doc: 5
Title: Old records
Author: Eli Gray
Status: Superseded
Type: Standards Track
Created: 01-Mar-1999
Superseded-By: 6

Abstract
========

The Record type keeps fields by name. Record values are plain, and a record_field has a name.
"""
NEW = """Doc: 6
Title: New Record types
Author: Eli Gray
Status: Final
Type: Standards Track
Created: 01-Mar-2006

Abstract
========

The Record type keeps fields by name and order. It goes beyond doc 5, and Record values are checked.

Non-goals
=========

A Record that changes its fields later is out of scope, because it is too hard to check for anyone.
"""
ALL = [BASE, EXTENSION, REJECTED, DRAFT, OLD, NEW]
