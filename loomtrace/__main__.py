import sys

from loomtrace.commands import main

sys.exit(main())
